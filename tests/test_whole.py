"""Nothing is cut: long runs, far pages, late arrivals, equal rows and lists longer than a form."""
from pyspark.sql import functions as F

from shirube.functions.text import arabic_numerals
from shirube.operators import lands, quotes, resolve
from shirube.plans import contract, extract
from shirube.sources import sinks
from shirube.streaming import jobs


def test_long_digit_runs(spark):
    run = "一二三四五六七八九〇" * 7
    texts = [f"番{run}", f"{run}番", "建物の名称" + "　" * 45 + "│" + run + " │", "山田一郎", f"第{run}の山"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(arabic_numerals(F.col("t"))).collect()]
    digits = "1234567890" * 7
    assert got == [f"番{digits}", f"{digits}番", "建物の名称" + "　" * 45 + "│" + digits + " │", "山田一郎", f"第{digits}の山"]


def test_form_overflow(spark):
    lots = [("町", f"{i}番", "宅地", 10.0) for i in range(1, 9)]
    floors = [(f"{i}階", 5.5) for i in range(1, 21)]
    cases = spark.createDataFrame([(1, lots, floors), (2, lots[:6], floors[:17]), (3, None, [])],
                                  "case_id int, land_lots array<struct<location:string,lot_number:string,land_category:string,area:double>>, floor_areas array<struct<floor:string,area:double>>")
    got = [(r.case_id, r.list, r.position, r["values"]) for r in contract.overflow(cases).orderBy("list", "position").collect()]
    assert got == [(1, "floor_areas", i, [f"{i}階", "5.5"]) for i in (18, 19, 20)] + [(1, "land_lots", i, ["町", f"{i}番", "宅地", "10"]) for i in (7, 8)]


def test_lease_term_over_blank_and_missing_pages(spark):
    pages = [("a", 1, "表題部 宅地 873：97 権利部（甲区）"), ("a", 2, "地上権設定 原因昭和47年1月"), ("a", 3, ""), ("a", 7, "31日設定 存続期間6"), ("a", 8, None), ("a", 9, "0年")]
    row = extract.leasehold_terms(spark.createDataFrame(pages, "file_hash string, page_no int, text string")).first()
    assert (row.status, str(row.period_start), str(row.period_end), row.period_years, str(row.area)) == ("parsed", "1972-01-31", "2032-01-30", 60, "873.97")


def test_late_document_is_kept_once(spark, tmp_path):
    schema = "file_hash string, arrived_at timestamp"
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    for rows in ([("a", "2026-01-01 12:00:00"), ("a", "2026-01-01 12:00:00")], [("b", "2026-01-01 10:00:00"), ("a", "2026-01-01 09:00:00")]):
        spark.createDataFrame(rows, "file_hash string, at string").select("file_hash", F.to_timestamp("at").alias("arrived_at")).write.mode("append").parquet(source)
        jobs.append_documents(jobs.stream_documents(spark, source, schema), target, checkpoint).awaitTermination()
    assert sorted(r.file_hash for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_equal_quotes_stay_apart(spark):
    wanted = spark.createDataFrame([("a", 1, "fee"), ("a", 1, "fee"), ("a", 2, "fee"), ("a", 1, ""), ("b", 1, None)], "doc string, page_no int, folded string")
    pages = spark.createDataFrame([("a", 1, "the fee is"), ("a", 1, "column"), ("a", 3, "x")], "doc string, page_no int, folded string")
    got = sorted((r.doc, r.page_no, r.folded or "", r.on_page, r.page_exists) for r in quotes.check_quotes(wanted, pages, ["doc"]).collect())
    assert got == [("a", 1, "", False, True), ("a", 1, "fee", True, True), ("a", 1, "fee", True, True), ("a", 2, "fee", False, False), ("b", 1, "", False, False)]


def test_title_on_a_late_page(spark):
    pages = spark.createDataFrame([("a", p, "本文" if p < 9 else "重要事項説明書") for p in range(1, 10)] + [("b", 1, "ま" * 400 + "用途地域"), ("c", 1, None)], "file_hash string, page_no int, text string")
    files = spark.createDataFrame([(h, "scan.pdf") for h in "abcd"], "file_hash string, name string")
    assert {r.file_hash: r.kind for r in resolve.classify(files, pages).collect()} == {"a": "purchase", "b": "zoning", "c": None, "d": None}
    assert {r.file_hash: r.kind for r in resolve.classify(files, pages, head_chars=300).collect()}["b"] is None


def test_shares_beyond_any_decimal(spark):
    big = "1" + "0" * 42
    rows = [("3", "7", None), ("200", "10000", "10000"), ("1", "50", "10000"), (big, "7" + big, "10000"), ("1", "3", "10000"), ("2", "4", big)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, d string, p string").orderBy("i").select(lands.printed_share(F.col("n"), F.col("d"), F.col("p"))).collect()]
    assert got == ["7分の3", "10000分の200", "10000分の200", f"7{big}分の{big}", "3分の1", "4分の2"]


def test_results_share_folders(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 50).cast("string").alias("case_id"), "id")
    sinks.write_results(rows, str(tmp_path / "out"), folders=4)
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 4
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 500 and back.filter(F.col("bucket") != F.pmod(F.xxhash64("case_id"), F.lit(4))).count() == 0


def test_quotes_of_small_files_are_found_without_grams(spark, monkeypatch):
    """A file's quotes are held against its pages at once; only files of more pairs than the bound are located by grams, with the same rows."""
    pages = spark.createDataFrame([(d, p, f"page{p}of{d}text" + "あ" * p) for d in ("a", "b") for p in range(1, 6)] + [(None, 1, "page1ofatext")], "doc string, page_no int, folded string")
    wanted = spark.createDataFrame([(i, d, 1, q) for d in ("a", "b", None) for i, q in enumerate(["page1", "page3of", "あああああ", "text", "", None, "あ", "ofz", "page3of"])], "id int, doc string, page_no int, folded string")
    columns = ["doc", "id", "folded", "on_page", "found_pages", "corrected_page", "needs_review"]

    def got(large=None):
        found = quotes.standing(wanted, pages, ["doc"], large).collect() if large is not None else quotes.correct_pages(wanted, pages, ["doc"]).select(*columns).collect()
        return sorted((tuple(r) for r in found), key=str)

    none = spark.createDataFrame([], "doc string")
    by_grams = got(spark.createDataFrame([("a",), ("b",)], "doc string"))
    assert got(spark.createDataFrame([("a",)], "doc string")) == by_grams
    assert [(r.doc) for r in quotes.large_files(wanted.filter("doc = 'a'"), pages, ["doc"], 44).collect()] == ["a"] and quotes.large_files(wanted, pages, ["doc"], 45).isEmpty()

    def no_grams(*_):
        raise AssertionError("grams")

    monkeypatch.setattr(quotes, "locate", no_grams)
    assert got(none) == by_grams and len(by_grams) == 2 * (1 + 1 + 1 + 5 + 5)
    assert {(r[0], r[1]): r[4:] for r in got()}[("a", 1)] == (1, 3, False)
