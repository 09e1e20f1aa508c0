"""Scores, assignment, tables and explanations of the linkage engine."""

import random

import pytest
from pyspark.sql import functions as F

from tallybridge.operators import arbiter, assign, explain, nearest, results, scoring, shortlist
from tallybridge.plans import cli, linkage
from tallybridge.sources import tables, xlsx

GOLDEN = [
    ("中国石油天然气股份有限公司", "中国石油化工股份有限公司", 45.425), ("中国建设银行股份有限公司", "中国银行股份有限公司", 19.9111), ("安永华明会计师事务所(特殊普通合伙)", "大华会计师事务所(特殊普通合伙)", 44.5123),
    ("顺丰控股股份有限公司", "顺丰快递股份有限公司", 46.0), ("腾讯", "深圳市腾讯计算机系统有限公司", 92.0), ("中国平安保险(集团)股份有限公司", "中国平安保险(集团)", 95.0),
]


@pytest.mark.parametrize("algorithm", ["weighted"])
def test_golden_pairs(spark, algorithm):
    a = spark.createDataFrame([(k, p[0]) for k, p in enumerate(GOLDEN)], "a_idx long, n string")
    b = spark.createDataFrame([(k, p[1]) for k, p in enumerate(GOLDEN)], "b_idx long, n string")
    got = {r.a_idx: r.score for r in scoring.score_records(a, b, "n", "n", algorithm=algorithm).where("a_idx = b_idx").collect()}
    assert [round(got[k], 4) for k in range(len(GOLDEN))] == [p[2] for p in GOLDEN]


def test_penalty_from_a_base_score_on(spark):
    a = spark.createDataFrame([(0, "上海哔哩哔哩科技有限公司"), (1, "中国海外发展有限公司")], "a_idx long, n string")
    b = spark.createDataFrame([(0, "上海哔哩哔哩有限公司"), (1, "深圳海外装饰工程有限公司")], "b_idx long, n string")
    all_pairs, from_55 = ({(r.a_idx, r.b_idx): r for r in scoring.score_records(a, b, "n", "n", penalty_from=p).collect()} for p in (0.0, 55.0))
    for k, r in from_55.items():
        assert r.base == all_pairs[k].base and r.penalty == all_pairs[k].penalty
        assert r.score == all_pairs[k].score if r.base >= 55 else r.score >= all_pairs[k].score
    assert any(r.base < 55 and r.penalty < 1 and r.score > all_pairs[k].score for k, r in from_55.items())


def test_scores_are_bounded_and_nothing_matches_empty_names(spark):
    names = ["", None, "顺丰", "顺 丰", "顺丰控股", "中国银行", "!!"]
    a = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "a_idx long, n string")
    b = a.withColumnRenamed("a_idx", "b_idx")
    rows = scoring.score_records(a, b, "n", "n", least=-1.0).collect()
    assert len(rows) == 49 and all(0 <= r.score <= 100 for r in rows)
    # a name of marks alone is empty as well once they are left out, which gives the weight of that measure
    assert all(r.score == (20 if 6 in (r.a_idx, r.b_idx) else 0) for r in rows if r.a_idx < 2 or r.b_idx < 2)
    assert {(r.a_idx, r.b_idx) for r in rows if r.score == 100} == {(2, 2), (2, 3), (3, 2), (3, 3), (4, 4), (5, 5), (6, 6)}
    with pytest.raises(ValueError):
        scoring.Thresholds(50, 60, 70)
    with pytest.raises(ValueError):
        scoring.describe("none")


def serial(a_rows, b_rows, points, floor, prune=False):
    """One after the other by best score, each takes its best untaken row; at score 0 the first one. (a_idx, b_idx, score, best_idx, best_score, displaced, assigned)."""

    def order(a, b):
        if not (p := points.get((a[1], b[1]), 0)):
            return (0, False, 0.0, b[0])
        return (-p, not (a[3] is not None and a[3] == b[3]), float("inf") if a[2] is None or b[2] is None else abs(a[2] - b[2]), b[0])

    best = {a[0]: min(b_rows, key=lambda b: order(a, b)) for a in a_rows}
    score = lambda a, b: points.get((a[1], b[1]), 0)
    taken, got = set(), {}
    for a in sorted((a for a in a_rows if score(a, best[a[0]]) >= floor), key=lambda a: (-score(a, best[a[0]]), a[0])):
        left = [b for b in b_rows if b[0] not in taken and (not prune or score(a, b) >= floor)]
        got[a[0]] = min(left, key=lambda b: order(a, b)) if left else None
        taken |= {got[a[0]][0]} if left else set()
    out = set()
    for a in a_rows:
        top, pick = best[a[0]], got.get(a[0])
        b, s = (pick, score(a, pick)) if pick else (top, 0 if a[0] in got else score(a, top))
        out.add((a[0], b[0], s / 10000, top[0], score(a, top) / 10000, bool(pick) and pick[0] != top[0], bool(pick)))
    return out


def served(spark, a_rows, b_rows, points, floor, k, prune=False, few=100, bound=100):
    """The same by short lists of k names, one by one or, with ``few`` below ``bound``, by rounds of proposals."""
    own = spark.createDataFrame(a_rows, "a_idx long, a_first long, x double, a_day string")
    rows = spark.createDataFrame(b_rows, "b_idx long, b_first long, y double, b_day string")
    scored = spark.createDataFrame([(a, b, p / 10000) for (a, b), p in points.items()] or [(0, 0, 0.0)], "a_first long, b_first long, score double").repartition(3).cache()
    least = lambda df: df.where(F.col("points") >= floor).withColumn("cut", F.when(F.col("cut") < floor, 0).otherwise(F.col("cut"))) if prune else df
    asked = []

    def longer(names_a, n, names_b):
        asked.append(n)
        left = scored.join(names_a, "a_first", "left_semi")
        return least(shortlist.shortlists(left if names_b is None else left.join(names_b, "b_first", "left_semi"), 12 * k)[0])

    lists, _ = shortlist.shortlists(scored, k)
    best, lists = assign.top_rows(own, least(lists) if prune else lists, rows, longer, bound)
    first = min(b[0] for b in b_rows)
    base = own.join(best, "a_idx", "left").withColumn("best_idx", F.coalesce("best_idx", F.lit(first))).withColumn("points", F.coalesce("points", F.lit(0)))
    takers = base.where(F.col("points") >= floor).select("a_idx", "a_first", assign.turn_of(F.col("points"), F.col("a_idx")).alias("turn"), "x", "a_day")
    takers = takers if prune else assign.first_in_turn(takers, len(b_rows))
    held = assign.serve(takers, lists, rows, longer, zero=not prune, sizes_known=bound, few=few)
    return {tuple(r) for r in assign.outcome(base, held, floor / 10000).collect()}, asked


def some_case(seed, n, m, names, values, share):
    rng = random.Random(seed)
    money = lambda: rng.choice([None, 1.0, 2.5, 4.0, 4.0, 7.0, float(rng.randint(0, 50))])
    day = lambda: rng.choice([None, "d1", "d2"])
    a_names, b_names = sorted(rng.sample(range(n), min(n, names))), sorted(rng.sample(range(m), min(m, names)))
    rows = lambda count, known: [(k, k if k in known else rng.choice([x for x in known if x < k] or [known[0]]), money(), day()) for k in range(known[0], count)]
    points = {(a, b): rng.choice(values) * 10000 for a in a_names for b in b_names if rng.random() < share}
    return rows(n, a_names), rows(m, b_names), points


@pytest.mark.parametrize("seed,n,m,names,share,k,few,prune", [
    (2, 25, 25, 25, 0.15, 8, 100, False), (3, 40, 30, 4, 0.8, 2, 100, False), (6, 12, 9, 6, 0.6, 8, 0, False), (3, 20, 15, 4, 0.8, 8, 0, True),
])
def test_assignment_is_the_serial_one(spark, seed, n, m, names, share, k, few, prune):
    a, b, points = some_case(seed, n, m, names, [20, 55, 60, 70, 80, 90, 100], share)
    got, _ = served(spark, a, b, points, 600000, k, prune, few)
    want = serial(a, b, points, 600000, prune)
    if prune:  # the best of a row below the floor is not kept then
        got, want = ({r for r in x if r[6]} for x in (got, want))
    assert got == want


def test_rows_without_candidates_take_the_first_free_ones(spark):
    """Every ledger row has one result; ledger rows outnumber statement rows, and candidates are few."""
    a = [(k, k, None, None) for k in range(30)]
    b = [(k, k, None, None) for k in range(20)]
    points = {(k, 19 - k % 3): (100 - k) * 10000 for k in range(30)}
    got, _ = served(spark, a, b, points, 600000, 5)
    assert got == serial(a, b, points, 600000) and len(got) == 30
    assert sum(r[6] for r in got) == 20 and sum(r[6] and r[2] == 0 for r in got) == 17
    a, b, points = a[:8], b[14:], {x: p for x, p in points.items() if x[0] < 8}  # by rounds
    assert served(spark, a, b, points, 600000, 5, few=0)[0] == serial(a, b, points, 600000)


def test_lists_run_out_and_large_choices(spark, monkeypatch):
    a, b, points = some_case(7, 50, 50, 50, [60, 70, 80], 1.0)
    got, asked = served(spark, a, b, points, 600000, 2)
    assert got == serial(a, b, points, 600000) and len(asked) > 1
    a, b, points = some_case(8, 8, 7, 3, [60, 70], 0.9)
    monkeypatch.setattr(assign, "choose", lambda *x, sizes_known=None: nearest.choose(*x, large=5))
    assert served(spark, a, b, points, 600000, 3, few=0)[0] == serial(a, b, points, 600000)


def test_very_many_equal_names(spark):
    """20,000 rows of one name on either side: no pair of records is made, and amounts that go one to one find each other."""
    n = 20000
    own = spark.range(n).selectExpr("id AS a_idx", "0L AS a_first", "CAST(id AS DOUBLE) AS x", "CAST(NULL AS STRING) AS a_day")
    rows = spark.range(n).selectExpr("id AS b_idx", "0L AS b_first", f"CAST(({n} - 1 - id) AS DOUBLE) AS y", "CAST(NULL AS STRING) AS b_day")
    lists = spark.createDataFrame([(0, 0, 1000000, 0)], "a_first long, b_first long, points long, cut long")
    takers = own.withColumn("turn", F.col("a_idx"))
    held = assign.serve(takers, lists, rows, None, sizes_known=n)
    assert held.where(F.col("a_idx") + F.col("b_idx") != n - 1).count() == 0 and held.count() == n


def test_claims_of_a_hot_row_are_split(spark):
    done = spark.range(50000).selectExpr("id AS a_idx", "IF(id % 5 = 0, id, -1) AS best_idx", "60.0 + id % 7 AS best_score")
    got = assign.claims(done, 60.0)
    hot = got.where("b_idx = -1").orderBy("rank").collect()
    assert [r.rank for r in hot] == list(range(1, 40001)) and {r.n for r in hot} == {40000}
    assert [(-r.score, r.a_idx) for r in hot] == sorted((-r.score, r.a_idx) for r in hot)
    assert got.where("b_idx >= 0").count() == 10000


A = [
    (0, "C1", "顺丰控股股份有限公司", "1,000", "2024-01-01"), (1, "C2", "顺丰控股股份有限公司", "500", "2024-01-02"), (2, "C3", "腾讯", "x", "2024-01-03"), (3, "C4", None, "1", None), (4, "C5", "无关商号", "2", "2024-01-05"),
]
B = [(0, "顺丰控股股份有限公司", "500", "2024-01-02"), (1, "深圳市腾讯计算机系统有限公司", "3", "2024-01-03"), (2, "顺丰　控股股份有限公司", "1000", "2024-01-01"), (3, "大华会计师事务所", "4", "2024-01-09")]


def sides(spark, a=A, b=B):
    return (
        spark.createDataFrame(a, "a_idx long, `客户编码` string, `客户名称` string, `交易金额（元）` string, `交易日期` string"),
        spark.createDataFrame(b, "b_idx long, `对方户名` string, `交易金额（元）` string, `交易日期` string"),
    )


def test_whole_run(spark):
    run = linkage.link(*sides(spark))
    got = {r["A系统-客户编码"]: r for r in run.matches.collect()}
    assert set(got) == {"C1", "C2", "C3"} and [got[k]["匹配序号"] for k in ("C1", "C2", "C3")] == [1, 2, 3]
    assert got["C2"]["交易日期"] == "2024-01-02" and got["C2"]["金额差异"] == 0 and got["C1"]["A系统-交易金额"] == 1000.0
    assert got["C3"]["相似度(%)"] == 92.0 and got["C3"]["匹配状态"] == "高度匹配"
    assert {r["客户编码"] for r in run.a_only.collect()} == {"C4", "C5"} and [r["对方户名"] for r in run.b_only.collect()] == ["大华会计师事务所"]
    s = {r.metric: (r.n, r.share) for r in run.summary.collect()}
    assert s["A系统总记录数"] == (5, 1.0) and s["总匹配成功数"] == (3, 0.6) and s["B系统独有记录"] == (1, 0.25)
    assert s["A系统独有记录"][0] + s["总匹配成功数"][0] == 5
    assert run.statistics.first().displaced == 0


def test_empty_sides(spark):
    a, b = sides(spark)
    run = linkage.link(a, b.limit(0))
    assert run.matches.count() == 0 and run.a_only.count() == 5 and run.b_only.count() == 0 and run.summary.count() == 9
    run = linkage.link(a.limit(0), b)
    assert run.a_only.count() == 0 and run.b_only.count() == 4


def test_missing_columns(spark):
    a, b = sides(spark)
    run = linkage.link(a.select("客户名称"), b.select("对方户名"))
    assert run.matches.count() == 3 and run.a_only.first()["部门"] == ""
    with pytest.raises(linkage.LinkageError):
        linkage.link(a.drop("客户名称"), b)


def test_explanations(spark):
    rows = [
        ("顺丰", "顺丰", "名称完全一致"), ("顺丰（集团）", "顺丰(集团)", "括号全/半角差异；清洗后一致"), ("顺 丰a", "顺丰A", "多余空格；英文大小写差异；清洗后一致"),
        ("中国建设银行股份有限公司", "中国银行股份有限公司", "关键字号冲突（「建设」仅一方含有）"), ("华兴科技有限公司", "华兴有限公司", "同一字号（通用词差异）（「华兴」）"),
        ("腾讯", "深圳市腾讯计算机系统有限公司", "包含关系（简称 vs 全称）"), ("甲乙丙股份有限公司", "甲丁丙股份有限公司", "疑似错别字（「乙」vs「丁」）"), ("宏达天然气", "宏达乳业3", "字号不同（「天然气」vs「乳业3」）；数字不同"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, want string")
    for r in df.select("*", explain.explain_text(explain.explain(F.col("a"), F.col("b"))).alias("got")).collect():
        if r.a == "腾讯":
            assert r.got.startswith("包含关系（丢弃公司后缀）（B多出「深圳市计算机系统有限公司」）")
        else:
            assert r.got == r.want


def test_differences(spark):
    rows = [
        ("顺丰", "顺丰", ["名称完全一致"]), ("顺丰（集团）", "顺丰(集团)", ["括号全/半角格式不同"]), ("顺 丰a", "顺丰A", ["存在多余空格", "含英文大小写差异"]), ("顺\u200b丰", "顺丰", ["含不可见字符"]), ("、", ",", ["清洗后完全一致"]),
        ("腾讯", "腾讯科技", ["B在A基础上附加「科技」", "长度 2字 vs 4字"]), ("深圳市腾讯", "腾讯", ["A在B基础上附加「深圳市」", "长度 5字 vs 2字"]),
        ("中国建设银行股份有限公司", "中国银行股份有限公司", ["字号不同「建设」vs「（无）」", "长度 12字 vs 10字"]), ("甲乙丙股份", "甲丁丙股份", ["第2字起不同「乙」vs「丁」"]),
        ("安永事务所(特殊)", "安永事务所(北京)", ["括号内附加信息不同"]), ("甲乙丙丁己(合伙)所", "甲戊丙壬己(合伙)所", ["字号不同「乙丙丁」vs「戊丙壬」"]),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want array<string>")
    assert [(r.a, r.got) for r in df.select("*", explain.differences(F.col("a"), F.col("b")).alias("got")).collect()] == [(a, want) for a, _, want in rows]


def test_tags_are_cut_after_the_limit(spark):
    tags = F.array(*[F.struct(F.lit(f"t{k}").alias("tag"), F.lit("").alias("detail")) for k in range(6)])
    assert spark.range(1).select(explain.explain_text(tags)).first()[0] == "t0；t1；t2；t3；t4；…（共6项）"


def test_arbiter(spark):
    said = '```json\n{"same_entity": true, "confidence": 0.8, "reason": " r "}\n```'
    want = arbiter.Verdict(True, 0.8, "r")
    for body in ({"content": said}, {"completion": said}, {"choices": [{"message": {"content": said}}]}, {"content": [{"text": said}]}):
        assert arbiter.parse_reply(body) == want
    assert arbiter.parse_reply({}) is None and arbiter.parse_reply({"content": "no"}) is None
    pairs = spark.createDataFrame([(0, 0, "x", "y", 65.0), (1, 1, "x", "z", 80.0), (2, 2, "bad", "z", 61.0)], "a_idx long, b_idx long, a_name string, b_name string, score double")

    def ask(x, y, context):
        if x == "bad":
            raise OSError
        return {"content": f'Here it is: {{"same_entity": false, "reason": "{context["score"]}"}}'}

    assert [tuple(r)[:5] for r in arbiter.arbitrate(pairs, ask).collect()] == [(0, 0, False, 0.5, "65.0")]
    assert arbiter.arbitrate(pairs, None).count() == 0


def test_arbiter_service(monkeypatch):
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"completion": '{"same_entity": true, "confidence": 0.9, "reason": "x"}'}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.delenv(arbiter.ENDPOINT, raising=False)
    assert arbiter.service() is None
    monkeypatch.setenv(arbiter.ENDPOINT, f"http://127.0.0.1:{server.server_port}/")
    monkeypatch.setenv(arbiter.KEY, "k")
    assert arbiter.parse_reply(arbiter.service(model="m")("甲", "乙", {"score": 61})) == arbiter.Verdict(True, 0.9, "x")
    (key, body) = asked[0]
    assert key == "Bearer k" and body["model"] == "m" and "甲" in body["messages"][0]["content"] and "61" in body["messages"][0]["content"]
    server.shutdown()


def test_workbooks(spark, tmp_path):
    run = linkage.link(*sides(spark))
    path, counts = tables.export_workbook(run, str(tmp_path), "t")
    assert xlsx.list_sheets(path) == ["模糊匹配结果", "A系统独有", "B系统独有", "匹配统计汇总"] and counts["模糊匹配结果"] == 3
    assert xlsx.read_rows(path, "匹配统计汇总")[-1][0].startswith("说明：") and counts["匹配统计汇总"] == 9
    guided = xlsx.ET.fromstring(f'<si xmlns="{xlsx._M[1:-1]}"><r><t>顺</t></r><r><t>丰</t></r><rPh sb="0" eb="1"><t>shun</t></rPh></si>')
    assert xlsx._text(guided) == "顺丰"
    rows = xlsx.read_rows(path, "A系统独有")
    assert rows[0][:3] == ["序号", "客户编码", "客户名称"] and [r[1] for r in rows[1:]] == ["C4", "C5"]
    book = tmp_path / "in.xlsx"
    xlsx.write_workbook(book, {"客户交易明细_A系统": (["title", ""], [("客户编码　", " 客户名称"), ("C1", " 顺丰 "), (None, None), ("C2", "12")])})
    df, info = tables.load_ledger(spark, str(book))
    assert info.header_row == 1 and info.header_hits == 2 and "部门" in info.missing
    assert [tuple(r) for r in df.collect()] == [("C1", " 顺丰 "), ("C2", "12")]
    with pytest.raises(linkage.LinkageError):
        tables.load_ledger(spark, str(book), "none")
    with pytest.raises(linkage.LinkageError):
        tables.load_ledger(spark, str(tmp_path / "absent.xlsx"))


def test_command_line(spark, tmp_path, capsys):
    a, b = sides(spark)
    a.drop("a_idx").write.parquet(str(tmp_path / "a"))
    b.drop("b_idx").write.parquet(str(tmp_path / "b"))
    assert cli.main(["--a-file", str(tmp_path / "a"), "--b-file", str(tmp_path / "b"), "--out-dir", str(tmp_path / "out"), "--parquet"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/matches")).count() == 3
    assert cli.main(["--a-file", str(tmp_path / "none.xlsx"), "--b-file", "x"], spark) == 1
    out = capsys.readouterr().out
    assert "U+817E U+8BAF" in out and "matched: 3" in out and "->" in out
    assert cli.main(["--a-file", str(tmp_path / "none"), "--b-file", "x"], spark) == 1 and "cannot be read" in capsys.readouterr().err
    assert cli.main(["--list-algo"], spark) == 0 and "weighted" in capsys.readouterr().out
    for bad in (["--high", "79"], ["--low", "81"], ["--floor", "71"], ["--algo", "none"]):
        with pytest.raises(SystemExit):
            cli.parse_args(bad)


def test_stream(spark, tmp_path):
    from tallybridge.streaming.scorer import best_for_stream

    a, b = sides(spark, b=[*B, (4, "", "1", None), (5, "%", "1", None)])
    b.write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "b"))
    got = {}

    def write(best, number):
        got.update({r.b_idx: (r.a_clean, r.score, r.tier) for r in best.collect()})

    q = best_for_stream(stream, a, "对方户名", "客户名称", write).start()
    q.processAllAvailable()
    q.stop()
    assert got[0][:2] == ("顺丰控股股份有限公司", 100.0) and got[1][:2] == ("腾讯", 92.0) and len(got) == 6
    assert got[4] == (None, 0.0, "A系统独有")  # an empty name is like nothing, a null ledger name included


def test_best_so_far_over_a_restart(spark, tmp_path):
    """Batches one after the other, a restart and a batch that is run again give what one batch over all rows gives."""
    from tallybridge.streaming import scorer

    a, b = sides(spark, b=[*B, (4, "", "1", None), (5, "%", "1", None)])
    schema = b.schema
    for k, rows in enumerate([b.where("b_idx > 2"), b.where("b_idx = 1"), b.where("b_idx IN (0, 2)")]):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
        folder = f"file://{tmp_path}/best"
        if k == 2:  # the last commit is lost, so its batch runs again
            number = scorer.finished(spark, folder)[-1]
            (tmp_path / f"best/checkpoint/commits/{number}").unlink()
            (tmp_path / f"best/checkpoint/commits/.{number}.crc").unlink(missing_ok=True)
        scorer.keep_best(stream, a, "对方户名", "客户名称", folder).trigger(availableNow=True).start().awaitTermination()
    got = {r.a_first: (r.b_idx, r.points) for r in scorer.best_so_far(spark, folder).collect()}
    x, y = scoring.names(a, "客户名称", "a", "a_idx"), scoring.names(b, "对方户名", "b", "b_idx")
    want = {}
    for r in scoring.score_names(x, y).select("a_first", "b_first", "score").collect():
        want[r.a_first] = min(want.get(r.a_first, (0, 10**9)), (-round(r.score * 10000), r.b_first))
    assert got == {k: (b_idx, -points) for k, (points, b_idx) in want.items()} and len(scorer.finished(spark, folder)) <= 2
    assert scorer.best_so_far(spark, f"file://{tmp_path}/none") is None


def test_text_with_title_lines(spark, tmp_path):
    import duckdb

    from tallybridge.sources.titled import read_titled

    rows = [(k, f"名{k}" if k % 7 else "", f"{k}.5") for k in range(3000)]
    lines = ["\ufeff交易明细", "由系统导出，2024", "", "客户名称　,序号,交易金额（元）,序号,"]
    lines += [f'"{n},甲",{k},{x},other,beyond,more' if n else f",{k}" if k % 2 else f",{k},{x}" for k, n, x in rows] + ["", "末,9999,1"]
    path = tmp_path / "ledger.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    df = read_titled(spark, str(path), ["客户名称", "序号"], rangeBytes=997)
    assert df.columns == ["客户名称", "序号", "交易金额（元）"] and df.rdd.getNumPartitions() > 40
    want = [(f"{n},甲" if n else None, str(k), None if not n and k % 2 else x) for k, n, x in rows]
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=lambda r: int(r[1]))[:-1] == want and ("末", "9999", "1") in got
    plain = tmp_path / "plain.csv"
    plain.write_text("title\nmore\nname,n\n" + "\n".join(f"x{k},{k}" for k in range(500)) + "\n")
    duck = duckdb.sql(f"SELECT * FROM read_csv('{plain}', skip=2, header=true, all_varchar=true)").fetchall()
    assert sorted(tuple(r) for r in read_titled(spark, str(plain), ["name"], rangeBytes=100).collect()) == sorted(duck)
    told, info = tables.load_ledger(spark, str(path))
    assert info.header_row == 3 and info.header_hits == 3 and told.count() == 3001
    (tmp_path / "gbk.csv").write_bytes("标题\n客户名称;序号\n顺丰;1\n".encode("gb18030"))
    assert [tuple(r) for r in read_titled(spark, str(tmp_path / "gbk.csv"), ["客户名称"], sep=";", encoding="gb18030").collect()] == [("顺丰", "1")]
    (tmp_path / "headed.csv").write_text("客户名称,交易金额（元）\n顺丰,1.5\n")
    told, info = tables.load_ledger(spark, str(tmp_path / "headed.csv"))
    assert info.header_row == 0 and told.schema["交易金额（元）"].dataType.typeName() == "double"
    (tmp_path / "bare.csv").write_text("title\n客户名称,序号")
    assert read_titled(spark, str(tmp_path / "bare.csv"), ["客户名称", "序号"]).count() == 0


def test_contained_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = lambda n: sorted({"".join(rng.choice("甲乙丙ab") for _ in range(rng.randint(0, 7))) for _ in range(n)})
    a, b = (spark.createDataFrame([(x,) for x in names(120)], f"{side}_clean string") for side in "ab")
    found = scoring.contained_pairs(a, b)
    every = a.crossJoin(b).withColumn("lift", F.rint(scoring.contained_score() * 10000) / 10000).where("lift > 0")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert scoring.contained_pairs(a.limit(0), b).count() == 0


def test_grid_makes_every_pair_once(spark, monkeypatch):
    a = spark.createDataFrame([(f"a{k}",) for k in range(23)], "a_clean string")
    b = spark.createDataFrame([(f"b{k}",) for k in range(17)], "b_clean string")
    monkeypatch.setattr(scoring, "BROADCAST_NAMES", 5)
    monkeypatch.setattr(scoring, "TILE_NAMES", 4)
    got = [tuple(r) for r in scoring.candidates(a, b).select("a_clean", "b_clean").collect()]
    assert len(got) == 23 * 17 == len(set(got))


def test_progress_and_log(spark):
    told, said = [], []
    linkage.link(*sides(spark), progress=lambda done, what: told.append(done), log=said.append)
    assert told == sorted(set(told)) and told[0] == 0 and told[-1] == 100 and len(told) >= 10
    assert any("matched: 3" in x for x in said) and any("rows: 5 and 4; changed by cleaning: 1 and 1; names on both sides: 1" in x for x in said)


def test_log_and_progress_add_no_job(spark):
    def jobs(**options):
        """Jobs so far."""
        linkage.link(*sides(spark), **options)
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId()

    before = jobs()
    plain, logged = jobs() - before, -jobs()
    assert logged + jobs(log=lambda text: None, progress=lambda done, what: None) == plain


def test_numbering_over_several_spans(spark):
    df = spark.range(0, 200_000, 997).withColumnRenamed("id", "a_idx")
    got = [r.seq for r in results._numbered(df, "a_idx", "seq").orderBy("a_idx").collect()]
    assert got == list(range(1, len(got) + 1))


def test_blocks_score_as_pairs_do(spark):
    """Scores of whole sides in blocks of equal lengths against those of single pairs, strings of over 64 characters included."""
    from tallybridge.functions import blocks

    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("甲乙丙ab()公司有限建设科技") for _ in range(n))
    names = lambda: ["", "%", "ab", *(text(rng.randint(1, 24)) for _ in range(45)), *(text(n) for n in (63, 64, 65, 70))]
    a, b = names(), names()
    b[5:9] = [a[5], a[6] + "科技", a[7][1:], a[8] + "有限公司"]
    x, y = (scoring.names(spark.createDataFrame([(n,) for n in side], "n string"), "n", s) for side, s in ((a, "a"), (b, "b")))
    told = lambda df, s: blocks.Side({c: [r[f"{s}_{c}"] for r in df] for c in blocks.PARTS})
    left, right = x.collect(), y.collect()
    for algorithm, least in (("weighted", 0.0), ("weighted", 55.0), ("partial", 0.0)):
        want = {(r.a_clean, r.b_clean): r.score for r in scoring.score_names(x, y, algorithm, penalty_from=least).select("a_clean", "b_clean", "score").collect()}
        got = blocks.scores(told(left, "a"), told(right, "b"), scoring.ALGORITHMS[algorithm], least)
        assert {(p.a_clean, q.b_clean): got[i, j] for i, p in enumerate(left) for j, q in enumerate(right)} == want


def test_served_one_by_one_by_the_rows_to_be_had(spark, monkeypatch):
    """As many are served as there are statement rows, however many ledger rows there are: rounds of proposals would take hours."""
    monkeypatch.setattr(assign, "FEW", 4)
    monkeypatch.setattr(assign, "_serve_by_rounds", None)
    assert linkage.link(*sides(spark)).done.where("matched").count() == 3  # 5 ledger rows, 4 statement rows


def test_lists_are_shared_by_takers_of_one_name(spark, monkeypatch):
    """One task's room holds a list of each name, not of each taker; lists that run out are made again over open names alone."""
    a, b, points = some_case(5, 40, 30, 6, [60, 65, 70, 75, 80, 85, 90, 95], 0.9)
    calls = []
    monkeypatch.setattr(assign, "ENTRIES", 40)
    way = assign.in_turn
    monkeypatch.setattr(assign, "in_turn", lambda zero: calls.append(1) or way(zero))
    got, _ = served(spark, a, b, points, 600000, 8)
    assert got == serial(a, b, points, 600000) and len(calls) == 1


def test_explanations_compute_names_once(spark):
    """What the tags of a pair share stands once in their expression, not in every place that it is used in."""
    df = spark.createDataFrame([("甲", "乙")], "a string, b string").select(explain.explain(F.col("a"), F.col("b")).alias("tags"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def _repeated(spark, path, n, m):
    """Tables of few names with many records each: keys that are a whole number of periods apart have one name."""
    period = 198360
    key = lambda count, names: f"CAST(id % {names} + {period} * FLOOR(id / {names}) AS BIGINT)"
    spark.range(n).selectExpr(f"{key(n, 7)} AS c_custkey", "CAST(id AS STRING) AS c_name", "CAST(id % 37 AS DOUBLE) AS c_acctbal", "'x' AS c_mktsegment").write.parquet(f"{path}/customer.parquet")
    spark.range(m).selectExpr(f"{key(m, 5)} AS s_suppkey", "CAST(id AS STRING) AS s_name", "CAST(id % 41 AS DOUBLE) AS s_acctbal", "1 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")


@pytest.mark.parametrize("query", ["mutual_ratio", "tie_break_ratio", "topk_ratio", "tiers_ratio", "score_ratio"])
def test_ratios_are_ranked_by_name(spark, tmp_path, monkeypatch, query):
    """Names are compared once, whatever the number of their records, and give what DuckDB makes of all pairs of records."""
    import duckdb

    from tallybridge.plans import catalogue

    _repeated(spark, tmp_path, 150, 120)
    monkeypatch.setattr(scoring, "candidates", None)  # makes pairs as rows
    df = catalogue.QUERIES[query](spark, str(tmp_path))
    duck = duckdb.connect()
    for table in ("customer", "supplier"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[query]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
