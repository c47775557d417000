"""Nested documents become field rows."""
from shirube.plans.flatten import flatten_fields

FIELD = "struct<value:string,sources:array<struct<page:int,text:string>>,needs_review:boolean>"


def test_paths_follow_the_schema(spark):
    node = lambda v, review=None: (v, [(1, v)], review)
    docs = spark.createDataFrame([("a", (node("見本ハイツ"),), [(node("7番1"),), (node("7番2", True),)], ["note"]), ("b", (node(None),), None, None)],
                                 f"file_hash string, building struct<name:{FIELD}>, lands array<struct<lot_number:{FIELD}>>, warnings array<string>")
    got = {(r.file_hash, r.path): (r.value, r.needs_review) for r in flatten_fields(docs).collect()}
    assert got == {("a", "building.name"): ("見本ハイツ", False), ("a", "lands.0.lot_number"): ("7番1", False), ("a", "lands.1.lot_number"): ("7番2", True), ("b", "building.name"): (None, False)}
