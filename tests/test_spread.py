"""Costly work per row is dealt over the session's partitions, and texts that need no folding stay out of Python."""
import random
import unicodedata

from pyspark.sql import functions as F

from shirube.functions import text as T
from shirube.plans import extract


def test_zoning_pages_of_one_partition_are_read_by_several_tasks(spark):
    pages = spark.range(64).coalesce(1).select(F.col("id").cast("string").alias("file_hash"), F.lit(1).alias("page_no"), F.lit("text").alias("mode"), F.lit("容積率  200％").alias("text"))
    fields, status = extract.zoning_extract(pages)
    assert len(fields.inputFiles()) > 1  # written by the tasks that read the pages, and read back for both results
    assert fields.count() == 64 and status.filter("status = 'needs_review'").count() == 64


def test_ledger_lines_of_one_partition_are_cut_by_several_tasks(spark, monkeypatch):
    from shirube.operators import segment
    from shirube.session import cut_lineage
    written = []
    monkeypatch.setattr(segment, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    lines = spark.range(64).coalesce(1).select(F.lit("f").alias("file_hash"), F.lit(1).alias("page_no"), F.col("id").alias("line_no"), F.lit("┃1│甲┃").alias("text"), F.array_repeat(F.lit(False), 5).alias("flags"))
    assert segment.segment_records(lines).count() == 64
    assert len(written[0].inputFiles()) > 1


def test_settled_texts_are_not_folded_in_python(spark, monkeypatch):
    monkeypatch.setattr(T, "_nfkc", lambda col: F.when(col.isNotNull(), "asked"))
    rows = [("┃　権　利　部　（甲区）┃",), ("持分1000分の1、カタカナ・ひらがな",), ("Ａ",), ("ｶﾞ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(T.nfkc(F.col("t")).alias("a"), T.nfkc_compact(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == ["asked", rows[1][0], "asked", "asked", None]
    assert [r.b for r in got] == ["asked", rows[1][0], "asked", "asked", None]
    spaced = spark.createDataFrame([("┃　権　利　部┃",)], "t string").select(T.nfkc_compact(F.col("t"))).first()[0]
    assert spaced == "┃権利部┃"


def test_folding_agrees_with_python(spark):
    draw = random.Random(5)
    pool = [chr(c) for c in [*range(32, 256), *range(0x3000, 0x3100), *range(0x2500, 0x2580), *range(0xFF00, 0xFFF0), 0x301, 0x3099, 0x309A, 0x2003, 0x85, 0x1100, 0x1161, 0xAC00, 0x4E00, 0x9FFF, 0xF900]]
    texts = pool + ["".join(draw.choices(pool, k=draw.randint(1, 6))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfkc(F.col("t")).alias("a"), T.nfkc_compact(F.col("t")).alias("b"), T.strip_spaces(F.col("a")).alias("c")).collect()
    assert all(r.a == unicodedata.normalize("NFKC", r.t) for r in got)
    assert all(r.b == r.c for r in got)


def test_legacy_documents_of_one_partition_are_parsed_by_several_tasks(spark):
    from shirube.plans import convert
    docs = spark.range(64).coalesce(1).select(F.col("id").alias("file_hash"), F.lit("12の3").alias("house_number"), F.lit('{"専有部分":{"家屋番号_枝番":"3"}}').alias("document"))
    _, units, values, rejects = convert.convert_legacy(docs)
    assert units.count() == 64 and values.filter("field_code = 'house_number'").count() == 64 and rejects.count() == 0
    assert len(units.inputFiles()) > 1


def test_shares_are_matched_by_one_pass_of_the_pattern(spark):
    from shirube.functions import shares
    rows = [("1万2345分の5,678", ("5678", "12345")), ("3億分の1億2万3", ("100020003", "300000000")), ("3/4", ("3", "4")), ("5/4", None), ("0/4", None), ("分の", None), ("1分の", None), ("x1分の1", None),
            ("1分の1/2", None), ("12345678901234567890分の1", ("1", "12345678901234567890")), ("123456789012345678901分の1", None), ("", None), (None, None), ("２分の１", ("1", "2"))]
    made = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", shares.parse_share(F.col("t")).alias("p"))
    got = {r.i: r.p and (str(r.p.n), str(r.p.d)) for r in made.collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
    plan = spark.range(1).select(F.lit("1分の1").alias("t")).select(shares.parse_share(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 0  # one replace gives all six groups, where each group matched the whole text again
