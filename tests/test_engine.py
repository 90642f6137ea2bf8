"""Scalars against plain Python, and writes, repair, retrieval, reports, sources and streams on small fixtures."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import entities, taxonomy, text
from docketry.functions.html import Page, page_facts
from docketry.operators import merge, repair, retrieve, stats
from docketry.plans.case_query import CaseQuery, page_of
from docketry.plans.report import report, to_html
from docketry.sources import tables
from docketry.streaming import ingest


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_multi_values(spark):
    got = values(spark, text.split_multi, ["a、b，c", " x / y ;; ", None, "", "p·q；r,s"])
    assert got == [["a", "b", "c"], ["x", "y"], [], [], ["p", "q", "r", "s"]]


def test_dates(spark):
    got = values(spark, lambda c: text.date_in(c).cast("string"), ["on 2024-2-5", "2026-02-31 or 2025年3月9日", "none", None, "2024 - 12 - 01"])
    assert got == ["2024-02-05", "2025-03-09", None, None, "2024-12-01"]
    assert values(spark, text.strict_date, ["2024-02-29", "2023-02-29", "2024-2-9", "x", None]) == ["2024-02-29", None, None, None, None]


def test_numerals(spark):
    assert values(spark, text.numeral, ["五", "十", "十一", "二十", "九十九", "二〇二六", "", "x"]) == [5, 10, 11, 20, 99, 2026, None, None]


def test_sign_off_dates(spark):
    tail = "。" * 250
    cases = ["2020年1月2日 then 2021年3月4日", "二〇二六年五月十一日", "2021年3月4日" + tail, "2021年13月4日", None, "x" * 3000 + "2019-07-08", "2020年1月2日 二〇一九年十二月三十一日"]
    assert values(spark, text.sign_off_date, cases) == ["2021-03-04", "2026-05-11", "", "", "", "2019-07-08", "2019-12-31"]


def test_quarters_and_bounds(spark):
    row = spark.range(1).select(text.quarter_before(F.lit(date(2024, 2, 10))).alias("q")).first().q
    assert (row["label"], row["first"], row["last"]) == ("2023Q4", date(2023, 10, 1), date(2023, 12, 31))
    low, high = text.ordered_bounds(F.lit("2024"), F.lit("2020"))
    assert spark.range(1).select(low.alias("a"), high.alias("b")).first()[:] == ("2020", "2024")


def test_identifiers(spark):
    urls = ["http://h/P202401020304050607080/x", "http://h/a/t20240101_55.html", "http://h/202401/ab-c", "http://h/c7615688/content.shtml", "http://h/some page?x=1"]
    assert values(spark, text.case_id_from_url, urls) == ["P202401020304050607080", "20240101_55", "202401_ab_c", "c7615688", "some_page_x_1"]
    assert values(spark, lambda c: text.document_number(c, F.lit("〔2020〕7号")), ["沪〔2025〕40号 x", "none", None]) == ["沪〔2025〕40号", "〔2020〕7号", "〔2020〕7号"]


def test_small_scalars(spark):
    assert values(spark, text.lenient_bool, ["Yes", "0", "maybe", None, " T "]) == [True, False, None, None, True]
    assert values(spark, text.clamp, ["7", "999", "-3", "x", None]) == [7, 40, 1, 15, 15]
    assert values(spark, text.file_name, [' a/b:c?"d" ']) == ["abcd"]
    assert values(spark, text.safe_url, ["HTTPS://x", "javascript:1", None]) == ["HTTPS://x", "", ""]
    assert values(spark, text.mask_secret, ["abcdefghijkl", "short"]) == ["********ijkl", "*****"]
    assert values(spark, text.entity_type, ["机构 + 个人", "个人/机构", "个人", "other x", None]) == ["机构、个人", "机构、个人", "个人", "otherx", ""]
    assert values(spark, text.json_object, ['```json\n{"a": 1,}\n```', 'so: {"b": [1, 2]} ok', "nothing", None]) == ['{"a": 1}', '{"b": [1, 2]}', None, None]


PIECES = st.lists(st.sampled_from(["{", "}", "[", "]", '"', "\\", ",", ":", " ", "\n", "1", "{}", '"a":', '{"b":', '"x}"', "NaN", "😀", "```", "null"]), max_size=14).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=200))
def test_objects_in_answers_are_those_of_the_driver(answers):
    spark = test_clip_agrees_with_python.spark
    found = values(spark, text.json_object, answers)
    assert [None if o is None else repr(json.loads(o)) for o in found] == [None if (want := retrieve.parse_answer(a)) is None else repr(want) for a in answers]


def test_objects_are_found_without_python(spark):
    df = spark.range(3).select(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit(",}")).alias("t"))
    plan = df.select(text.json_object(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    answers = ['{"a": "x}\\"{", "b": {"c": [1, {"d": 2}]}} t {"e": 1}', '{"a": 1, "a": 2}', "{'a': 1}", '{"a": 1', "", '{"s": "' + "{" * 20000 + '"}']
    assert values(spark, text.json_object, answers) == ['{"a": "x}\\"{", "b": {"c": [1, {"d": 2}]}}', '{"a": 1, "a": 2}', None, None, None, answers[-1]]


def test_titles_of_several_actions(spark):
    words = entities.Lexicon(sentence_marks=("经查",), action_marks=("对",), actions=("采取", "出具", "责令"), pronouns=("其", "该"))
    titles = ["关于对甲公司、乙银行、张三采取责令改正并对丙公司、甲公司出具警示函的决定", "关于对张西湖采取措施", "对该丁公司责令改正", "对经查某某、乙银行采取措施", "对甲公司，乙采取措施", "通知", "", None]
    assert values(spark, lambda c: entities.parties_of_actions(c, words), titles) == ["甲公司、乙银行、张三、丙公司", "张西湖", "丁公司", "乙银行", "", "", "", ""]
    assert values(spark, lambda c: entities.is_compound(c, words), titles) == [True, *[False] * 7]
    assert values(spark, lambda c: entities.parties_of_actions(c, entities.Lexicon()), titles[:1]) == [""]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t…x", max_size=30), min_size=1, max_size=8))
def test_clip_agrees_with_python(texts):
    spark = test_clip_agrees_with_python.spark
    want = []
    for t in texts:
        flat = re.sub(r"\s+", " ", t).strip(" ")
        want.append(flat if len(flat) <= 10 else flat[:9] + "…")
    assert values(spark, lambda c: text.clip(c, 10), texts) == want


@pytest.fixture(autouse=True)
def _spark_for_properties(spark):
    test_clip_agrees_with_python.spark = spark


TAXONOMY = [taxonomy.Tag("late report", ("overdue",), {"a": "Late"}), taxonomy.Tag("fraud", ("forged", "fake")), taxonomy.Tag("other", whole=True)]


def test_taxonomy(spark):
    got = values(spark, lambda c: taxonomy.normalise(c, TAXONOMY), ["overdue；forged papers、x", "late report: fake", "", None, "another、other"])
    assert got == [["late report", "fraud", "x"], ["late report", "fraud"], ["unclassified"], ["unclassified"], ["another", "other"]]
    assert values(spark, lambda c: taxonomy.canonical(c, TAXONOMY), ["x、overdue", None]) == [["late report"], []]
    assert values(spark, lambda c: taxonomy.label(c, F.lit("a"), TAXONOMY), ["late report", "fraud"]) == ["Late", "fraud"]
    assert values(spark, lambda c: taxonomy.category(c, [("fine", ("fined",)), ("ban", ("barred", "ban"))]), ["was fined", "a ban", "none", None]) == ["fine", "ban", "other", "other"]


def cases(spark, *rows):
    return spark.createDataFrame(rows, "dataset string, case_id string, status string, title string")


def test_upsert_keeps_the_lattice(spark):
    target = cases(spark, ("a", "1", "done", "old"), ("a", "2", "failed", "old"), ("a", "3", "skipped", "old"), ("b", "1", "done", "old"))
    source = spark.createDataFrame([("a", "1", "pending", "", 1), ("a", "2", "pending", "n", 2), ("a", "3", "done", "n", 3), ("c", "9", "pending", "n", 4), ("c", "9", "done", "last", 5), (None, "x", "done", "n", 6)], "dataset string, case_id string, status string, title string, seq int")
    out = sorted(map(tuple, merge.upsert(target, merge.last_by_key(source).drop("seq")).collect()))
    assert out == [("a", "1", "done", ""), ("a", "2", "pending", "n"), ("a", "3", "done", "n"), ("b", "1", "done", "old"), ("c", "9", "done", "last")]


def test_fill_bridge_delete_retain(spark):
    target = cases(spark, ("a", "1", "done", " "), ("a", "2", "done", "kept"))
    filled = merge.fill(target, cases(spark, ("a", "1", "", "new"), ("a", "1", "", "n"), ("a", "2", "", "new")), "title").collect()
    assert len(filled) == 2
    assert {r.case_id: r.title for r in filled} == {"1": "new", "2": "kept"}
    bridge = spark.createDataFrame([("a", "1", "stale"), ("a", "2", "x")], "dataset string, case_id string, violation string")
    links = spark.createDataFrame([("a", "2", "y"), ("a", "2", "y")], "dataset string, case_id string, violation string")
    assert sorted(r.violation for r in merge.replace_bridge(bridge, target, links).collect()) == ["y"]
    assert [r.case_id for r in merge.delete(target, target.filter("case_id = '1'")).collect()] == ["2"]
    tasks = spark.createDataFrame([(str(i), "done" if i < 5 else "running", f"2024-01-0{i + 1}", i) for i in range(6)], "id string, status string, created_at string, seq int")
    assert sorted(r.id for r in merge.retain(tasks, ("done",), 2).collect()) == ["3", "4", "5"]


REPAIR = "dataset string, case_id string, title string, raw_text string, status string, status_note string, punished_entity string, punished_entities string, summary_entity string, entity_type string, document_number string, punishment_date string"
WORDS = entities.Lexicon(measures=("受到处罚",), sentence_marks=("经查",), org_suffixes=("公司", "银行"), party_prefixes=("当事人：",), title_forms=(("注销", "的公告"),), org_types=(("银行", "bank"),))


def test_repair_passes_and_dry_run(spark):
    rows = spark.createDataFrame(
        [
            ("a", "1", "注销某某公司的公告", "", "done", "", "", "", "", "机构+个人", "", ""),
            ("b", "2", "张三受到处罚的决定", "内容 沪〔2025〕4号 结尾 2024年5月6日", "done", "", "", "张三受到处罚", "经查，张三违反规定", "个人", "", "2024-02-30"),
            ("b", "3", "plain", "", "done", "", "", "甲公司", "甲公司", "机构", "〔2020〕1号", "2020-01-01"),
            ("b", None, None, None, None, None, None, None, None, None, None, None),
        ],
        REPAIR,
    )
    out = {r.case_id: r for r in repair.repair(rows, WORDS, "a").collect()}
    assert out["1"].punished_entity == "某某公司" == out["1"].summary_entity and out["1"].entity_type == "机构、个人"
    assert out["2"].punished_entities == "张三" == out["2"].summary_entity and out["2"].document_number == "沪〔2025〕4号" and out["2"].punishment_date == ""
    assert out["3"].repairs == [] and set(rows.columns) < set(repair.repair(rows, WORDS, "a").columns)
    again = repair.repair(repair.repair(rows, WORDS, "a").drop("repairs"), WORDS, "a").filter(F.size("repairs") > 0).collect()
    assert {p for r in again for p in r.repairs} <= {"fill_date"}  # a cleared date is filled from the text on the next run
    dry = {r["name"]: r.candidates for r in repair.dry_run(rows, WORDS, "a").collect()}
    assert dry["fill_first_party"] == 1 and dry["entity_type"] == 1 and dry["clear_date"] == 1


def test_names(spark):
    got = lambda f, xs: values(spark, lambda c: f(c, WORDS), xs)
    assert got(entities.party_from_title, ["决定书（李四）", "公告 - 乙银行", "函（王五", "乙公司受到处罚", None, "经查（经查，他）"]) == ["李四", "乙银行", "王五", "乙公司", "", ""]
    assert got(entities.is_person, ["张三", "甲公司", "John Smith", "john", "", None]) == [True, False, True, False, False, False]
    assert got(entities.is_person_line, ["张三、李四", "张三", "张三、甲公司", None]) == [True, False, False, False]
    assert got(entities.is_dirty, ["甲公司", "经查，甲", "甲公司受到处罚", "他说。", "甲（乙", "x" * 61, "", None]) == [False, True, True, True, True, True, False, False]
    assert got(entities.clean_parties, ["甲公司受到处罚、乙、甲公司，丙银行：", None]) == ["甲公司、丙银行", ""]
    body = lambda c: entities.organisation_from_body(c, F.lit("丁"), WORDS)
    assert values(spark, body, ["甲公司与，丁戊公司", "当事人：李四，男", "只有乙银行", "none", None]) == ["丁戊公司", "李四", "只有乙银行", "", ""]
    assert got(entities.organisation_type, ["某银行", "x" * 3000 + "银行", None]) == ["bank", "", ""]


def test_queries_compile(spark, tiny):
    rows = schemas.case_rows(spark, tiny)
    with pytest.raises(ValueError):
        CaseQuery().aggregate(rows, "nope")
    assert not CaseQuery(datasets=("en",)).needs_summary() and CaseQuery(entity_types=("org",)).needs_summary()
    assert page_of(9, 45) == (3, 40) and page_of(0, 0) == (1, 0)
    with pytest.raises(ValueError):
        CaseQuery(violations=("v",)).filtered(rows)
    bridge = rows.filter("case_id % 2 = 0").select("dataset", "case_id", F.lit("v").alias("violation"))
    plan = CaseQuery(violations=("v",)).filtered(rows, bridge)
    assert "LeftSemi" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count() == rows.filter("case_id % 2 = 0").count()
    top = CaseQuery(limit=5).search(rows)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
    pushed = spark.read.parquet(f"{tiny}/documents.parquet").filter("n_chars > 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars)" in pushed


def test_citations_and_counters(spark):
    rows = spark.createDataFrame([("《证券法》第一条、第二条",), ("《证券法》；办法",), (None,)], "c string")
    assert {r.value: r.cases for r in stats.citations(rows, F.col("c")).collect()} == {"证券法": 2, "办法": 1}


def test_intents(spark):
    got = retrieve.Intent.of({"keywords": ["a", "a", ""], "violations": ["t", "u"], "datasets": ["x", "bad"], "date_from": "2024-05-01", "date_to": "2023-01-01", "limit": 999, "mode": "?"}, {"t"}, {"x"})
    assert got == retrieve.Intent("search", ("a", "u"), ("t",), ("x",), "2023-01-01", "2024-05-01", 40)
    assert got.query().statuses == ("done",) and retrieve.Intent.fallback("q" * 50).keywords == ("q" * 30,)
    assert retrieve.parse_answer('text {bad {"a": 1,} more') == {"a": 1} and retrieve.parse_answer("") is None


PAGE = """<html><head><title>List</title><script>no</script></head><body><nav>menu</nav><div class="content"><p>First <b>line</b></p><p>second&nbsp;line %s</p></div>
<ul><li><a href="/c1">One</a> 2024-01-05</li><li><a href="/c2">Two</a> 2023-01-05</li></ul><div class="attachment-down"><a href="f.pdf">get</a></div><footer>end</footer></body></html>""" % ("x" * 100)


def test_pages(spark):
    page = Page(PAGE)
    assert page.main_text().startswith("First line\nsecond line xxx") and "menu" not in page.main_text()
    assert page.attachment("http://h/a/b") == ("http://h/a/f.pdf", 1)
    df = spark.createDataFrame([(1, "http://h/", PAGE), (2, "http://h/", "<title>404 Not Found</title>"), (3, None, None), (4, "http://h/", "<title>Order 404/2020</title>")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in page_facts(df).collect()}
    assert [i.title for i in rows[1]["items"]] == ["One", "Two"] and rows[2].soft_404 and not rows[4].soft_404 and rows[3].main_text == ""
    links = tables.list_pages(df, "2024-01-01", "2024-12-31").collect()
    assert [(r.link_url, r.date) for r in links] == [("/c1", "2024-01-05")]


def test_sources(spark, tmp_path):
    class Echo:
        def get(self, url):
            return None if url.endswith("2") else f"body of {url}"

    answers = spark.createDataFrame([('{"name": "n", "href": "u", "date": "2024-01-02 03:04"}',), ("broken",)], "body string")
    assert sorted(map(tuple, tables.api_links(answers).collect())) == [("", "", ""), ("n", "u", "2024-01-02")]
    links = spark.createDataFrame([("a1",), ("a2",)], "link_url string")
    assert {r.link_url: r.body for r in tables.fetch(links, Echo).collect()} == {"a1": "body of a1", "a2": None}
    tables.write_csv(links, str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbflink_url")
    links.write.parquet(str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), schemas.META).columns == ["key", "value", "updated_at"]
    tasks = spark.createDataFrame([('{"a": "1"}',), ("bad",), (None,)], "params string")
    assert [r.params for r in tables.task_params(tasks).collect()] == [{"a": "1"}, {}, {}]


def test_report(spark):
    df = spark.createDataFrame([("a|b", 2), (None, 1)], "value string, cases int")
    out = report("Title", {"First": df, "None": df.limit(0)}, day=date(2024, 1, 2))
    assert "| 1 | a\\|b | 2 |" in out and "(none)" in out and "Advice" not in out
    assert "<h1>Title</h1>" in to_html(out) and "&lt;" in to_html("a < b")


def test_streams_deduplicate_and_merge(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [(i % 30, start + timedelta(hours=i % 30), "k", 1.0) for i in range(60)] + [(99, start + timedelta(days=30), "k", 1.0)]
    spark.createDataFrame(events, "event_id int, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    days = {r.day: r.events for r in ingest.drain(ingest.daily(ingest.deduplicated(stream))).collect()}
    assert days == {"2024-01-01": 24, "2024-01-02": 6}

    spark.createDataFrame([("a", "1", "pending", "n", 1), ("a", "2", "done", "n", 2), ("z", "9", "done", "n", 3)], "dataset string, case_id string, status string, title string, seq int").write.parquet(str(tmp_path / "records"))
    records = spark.readStream.schema("dataset string, case_id string, status string, title string, seq int").parquet(str(tmp_path / "records"))
    held = {"now": cases(spark, ("a", "1", "done", "old"))}
    ingest.upsert_stream(records, lambda: held["now"], lambda df, n: held.update(now=spark.createDataFrame(df.collect(), df.schema)), str(tmp_path / "cp"), lambda: cases(spark, ("z", "9", "", ""))).awaitTermination()
    assert sorted(map(tuple, held["now"].collect())) == [("a", "1", "done", "n"), ("a", "2", "done", "n")]


def test_text_queries_read_whole_texts(spark, tmp_path):
    from docketry import catalog

    long = "x " * 400
    texts = [(12, long + "2019年7月8日"), (13, long + " 2020-3-4 " + long + "二〇二一年三月五日"), (14, long + "沪〔2024〕9号 on 2022-02-03"), (15, None), (16, "2018年1月2日" + long * 3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("sign_off_date")[12] == "2019-07-08"  # the made-up date has month 13
    assert got("sign_off_dates_in_texts") == {12: "2019-07-08", 13: "2021-03-05", 14: "2022-02-03", 15: "", 16: ""}
    assert got("dates_in_texts") == {12: "2019-07-08", 13: "2020-03-04", 14: "2022-02-03", 15: None, 16: "2018-01-02"}
    assert got("document_numbers_in_texts") == {12: "", 13: "", 14: "沪〔2024〕9号", 15: "", 16: ""}
