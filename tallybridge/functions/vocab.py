"""Fixed values of the name rules: word lists, character tables and constants that results depend on."""

from __future__ import annotations

# --- fixed values: regions -------------------------------------------------------------------------------------------------------------
REGIONS = (
    "中国 中华 北京 上海 天津 重庆 广州 深圳 广东 江苏 浙江 山东 河南 河北 四川 湖北 湖南 福建 安徽 陕西 辽宁 江西 云南 广西 山西 内蒙古 新疆 "
    "贵州 甘肃 海南 宁夏 青海 西藏 吉林 黑龙江 香港 澳门 台湾 苏州 杭州 南京 武汉 成都 西安 青岛 大连 宁波 厦门 无锡 佛山 东莞 郑州 长沙 "
    "合肥 福州 济南 沈阳 哈尔滨"
).split()
#: Explanations know one region more.
EXPLAINED_REGIONS = [*REGIONS, "乌鲁木齐"]

# --- fixed values: words that don't tell firms apart -------------------------------------------------------------------------------------
GENERIC = (
    "股份有限公司 有限责任公司 集团有限公司 有限公司 股份公司 集团 公司 事务所 会计师事务所 研究院 研究所 中心 合伙企业 厂 店 "
    "科技 网络 信息 技术 服务 咨询 管理 在线 计算机 系统 电子 实业 发展 投资 国际 贸易 银行 保险 证券 基金 信托 租赁 石油"
).split()

# --- fixed values: names that only one side may have -------------------------------------------------------------------------------------
PROTECTED = "建设 工商 农业 交通 招商 民生 光大 平安 浦发 中信 兴业".split()

# --- fixed values: lines of business -----------------------------------------------------------------------------------------------------
INDUSTRIES = (
    "控股 快递 物流 速递 重工 乳业 制药 新药开发 天然气 化工 医药 地产 置业 能源 汽车 钢铁 水泥 航空 电力 机械 工程 建筑 环保 通信 "
    "半导体 新能源 生物 材料 食品 饮料 传媒 教育 旅游 酒店 农业 证券 基金 信托 租赁"
).split()

# --- fixed values: words that explanations classify extra text by -------------------------------------------------------------------------
BRANCHES = "分公司 分行 分所 办事处 营业部 支公司 分厂 分部 分局 分店 连锁店 门店".split()
ORGANISATIONS = (
    "集团 特殊普通合伙 有限合伙 普通合伙 合伙企业 控股 股份有限公司 有限责任公司 有限公司 公司 事务所 研究院 研究所 中心 厂 商行 银行 保险 证券 基金 信托"
).split()

# --- fixed values: characters -------------------------------------------------------------------------------------------------------------
#: Marks and their half-width forms, beside U+FF01 to U+FF5E, which lie 0xFEE0 above theirs.
WIDE_MARKS = "、。〈〉《》【】‘’“”–—―−·"
NARROW_MARKS = ",.<><>[]''\"\"----."
#: Code points of invisible characters, first and last of each range.
INVISIBLE = [
    (0x0000, 0x0008), (0x0009, 0x000D), (0x000E, 0x001F), (0x007F, 0x009F), (0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0x00AD, 0x00AD), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F),
    (0x0890, 0x0891), (0x08E2, 0x08E2), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF),
    (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001),
    (0xE0020, 0xE007F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180D), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF),
]
#: Marks left out of the punctuation-free name.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~、。〈〉《》「」『』【】〔〕（）［］｛｝，．；：？！…—–―·～￥"

# --- fixed values: weights and rule constants ---------------------------------------------------------------------------------------------
WEIGHTS = {"ratio": 0.45, "partial": 0.20, "wratio": 0.15, "core": 0.20}
PENALTY_MILD, PENALTY_TWO, PENALTY_HEAVY, PENALTY_LONG = 0.90, 0.55, 0.50, 0.40
CORE_KEEP, CORE_MILD = 70.0, 45.0
SAME_FOLD_SCORE = 95.0
INDUSTRY_FACTOR, INDUSTRY_BELOW, INDUSTRY_TOP = 1.15, 60.0, 59.9
CONFLICT_FACTOR, CONFLICT_TOP = 0.40, 50.0
CONTAINED_EDGE, CONTAINED_INSIDE, CONTAINED_SHORT, CONTAINED_SHORT_LENGTH, CONTAINED_LEAST_LENGTH = 15.0, 28.0, 92.0, 3, 2

# --- fixed values: texts that results carry ------------------------------------------------------------------------------------------------
TIERS = ["完全匹配", "高度匹配", "中低匹配", "低置信度匹配", "A系统独有"]
TAGS = [
    "名称完全一致", "清洗后一致", "括号全/半角差异", "多余空格", "不可见字符", "英文大小写差异", "包含关系（丢弃公司后缀）", "包含关系（附加地区）",
    "包含关系（附加分支机构）", "包含关系（附加组织形式）", "包含关系（简称 vs 全称）", "字号一致", "疑似错别字", "字号不同", "同一字号（通用词差异）", "括号附注不同",
    "关键字号冲突", "括号内信息不同", "含中英文字符", "数字不同", "长度差异", "非互为最优", "已让位（首选被更高分记录认领）", "低置信度（建议逐条核实）",
]
#: Differences of two raw names as the console shows them.
DIFFERENCES = {
    "same": "名称完全一致", "brackets": "括号全/半角格式不同", "invisible": "含不可见字符", "spaces": "存在多余空格", "case": "含英文大小写差异", "clean": "清洗后完全一致", "added_b": "B在A基础上附加",
    "added_a": "A在B基础上附加", "other": "字号不同", "near": "字号近似", "notes": "括号内附加信息不同", "from": "第{}字起不同", "length": "长度 {}字 vs {}字", "none": "（无）", "unknown": "字符存在差异",
}
#: What invisible characters are called in reports.
MEANINGS = {
    0x00A0: "NBSP 不换行空格", 0x3000: "IDEOGRAPHIC SPACE 全角空格", 0x200B: "ZERO WIDTH SPACE 零宽空格", 0xFEFF: "BOM / ZERO WIDTH NO-BREAK SPACE", 0x0009: "TAB 制表符", 0x000A: "LF 换行", 0x000D: "CR 回车",
    0x2028: "LINE SEPARATOR 行分隔符", 0x2029: "PARAGRAPH SEPARATOR 段分隔符",
}
A_COLUMNS = ["序号", "客户编码", "客户名称", "交易金额（元）", "交易日期", "业务类型", "部门"]
B_COLUMNS = ["序号", "对方户名", "对方账号", "交易金额（元）", "交易日期", "流水号", "摘要"]
