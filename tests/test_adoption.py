"""Adoption as store updates, against a writer that takes requests one by one."""
import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from shirube import schemas
from shirube.operators.settle import settle
from shirube.plans import adoption as A
from shirube.workload import adoption as workload_adoption
from shirube.session import FREE_SHUFFLES, cut_lineage
from shirube.sources import commits
from shirube.workload.adapter import order_values

DAY = dt.date(2026, 1, 1)
at = lambda m: dt.datetime(2026, 3, 1) + dt.timedelta(minutes=m)


@pytest.mark.parametrize("seed", range(4))
def test_settle_like_one_writer(spark, seed):
    rng, rows = random.Random(seed), []
    for r in range(120):
        for t in rng.sample(range(40), rng.choice([1, 1, 2, 3, 5])):
            rows.append((f"r{r}", t if t else None, rng.choice("abc"), (rng.randrange(1000), r)))
    by_request, tickets = {}, {}
    for r, t, c, k in rows:
        by_request.setdefault(r, []).append((t, c))
        tickets.setdefault(r, (k[0], k[1]))
    rows = [(r, t, c, tickets[r]) for r, t, c, _ in rows]
    taken, want = {}, {}
    for r in sorted(by_request, key=lambda r: tickets[r]):
        won = all(taken.get(t, c) == c for t, c in by_request[r])
        for t, c in by_request[r]:
            want[r, t] = (won, won and t not in taken)
        if won:
            taken |= dict(by_request[r])
    claims = spark.createDataFrame(rows, "request_id string, target int, choice string, ticket struct<at:int,n:int>")
    got = {(r.request_id, r.target): (r.won, r.fresh) for r in settle(claims).collect()}
    assert got == want


def test_settle_nothing(spark):
    assert settle(spark.createDataFrame([], "request_id string, target int, choice string, ticket int")).count() == 0


def frame(spark, name, rows, defaults=None):
    schema = schemas.STORE[name]
    names = [p.strip().split(" ")[0] for p in schema.split(", ")] if name not in ("units", "buildings") else spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple({**(defaults or {}), **r}.get(c) for c in names) for r in rows], schema)


def report_store(spark):
    """Document d of unit u: version 1 approved, 2 and 3 saved against it; rules of building b; a registry document."""
    value = dict(confidence=0.95, page_no=1, source_text="quote", needs_review=False, approved=False, reviewed=False, value_as_of_date=DAY)
    def v(i, version, field, text, **kw):
        return {**value, "extracted_value_id": i, "document_version_id": version, "field_code": field, "value_json": text, "created_at": at(int(version[1:])), **kw}
    values = [v("a1", "v1", "management_fee", "100", approved=True, reviewed=True), v("b1", "v1", "repair_reserve_fee", "10", approved=True, reviewed=True),
              v("a2", "v2", "management_fee", "120", value_as_of_date=dt.date(2026, 2, 1)), v("b2", "v2", "repair_reserve_fee", "12", needs_review=True), v("c2", "v2", "balance", "1", source_text=""),
              v("a3", "v3", "management_fee", "130", value_as_of_date=dt.date(2026, 2, 2)), v("b3", "v3", "repair_reserve_fee", "13", value_as_of_date=dt.date(2025, 2, 2)),
              v("r4", "v4", "pet_restrictions", '"no"', approved=True), v("r5", "v5", "pet_restrictions", '"yes"'), v("r6", "v6", "pet_restrictions", '"some"', needs_review=None),
              v("g7", "v7", "current_owner_name", '"new"'), v("g8", "v8", "current_owner_name", '"newer"', value_as_of_date=dt.date(2025, 1, 1))]
    version = lambda i, d, n, current=False: dict(document_version_id=i, document_id=d, version_no=n, is_current=current)
    diff = lambda i, d, old, new, f, a, b, affected=None, status="unreviewed": dict(diff_id=i, document_id=d, old_version_id=old, new_version_id=new, field_code=f, old_value_json=a, new_value_json=b, review_status=status, affected_field=affected)
    store = {
        "documents": frame(spark, "documents", [dict(document_id="d", document_type="important_report", unit_id="u", building_id="b"), dict(document_id="m", document_type="management_rules", building_id="b"), dict(document_id="g", document_type="registry", unit_id="u", building_id="b")]),
        "versions": frame(spark, "versions", [version("v1", "d", 1, True), version("v2", "d", 2), version("v3", "d", 3), version("v4", "m", 1, True), version("v5", "m", 2), version("v6", "m", 3), version("v7", "g", 1), version("v8", "g", 2)]),
        "values": frame(spark, "values", values),
        "diffs": frame(spark, "diffs", [diff("x2", "d", "v1", "v2", "management_fee", "100", "120"), diff("x3", "d", "v1", "v3", "management_fee", "100", "130"),
                                        diff("y5", "m", "v4", "v5", "pet_restrictions", '"no"', '"yes"'), diff("y6", "m", "v5", "v6", "pet_restrictions", '"yes"', '"some"'),
                                        diff("p5", "m", "v4", "v5", "pet_restrictions", '"no"', '"yes"', "purchase:k"), diff("p8", "g", "v7", "v8", "current_owner_name", '"new"', '"newer"', "purchase:k"),
                                        diff("g7", "g", None, "v7", "current_owner_name", '"old"', '"new"', "units.current_owner_name"), diff("g8", "g", None, "v8", "current_owner_name", '"old"', '"newer"', "units.current_owner_name")]),
        "cases": frame(spark, "cases", [dict(case_id="k", unit_id="u", purchase_values={"pet_restrictions": "r4", "current_owner_name": "g7"}), dict(case_id="e", unit_id="u")]),
        "units": frame(spark, "units", [dict(unit_id="u", building_id="b", current_owner_name="old", management_fee=None)]),
        "buildings": frame(spark, "buildings", [dict(building_id="b", building_name="x")]),
        "imports": frame(spark, "imports", []),
        "baselines": spark.createDataFrame([(v, f, f"{p}1") for v in ("v2", "v3") for f, p in (("management_fee", "a"), ("repair_reserve_fee", "b"))], A.BASELINES)}
    return store


def outcome(adoption):
    return {(r.request_id, r.field_code): (r.decision, r.reason) for r in adoption.decisions.collect()}


REPORT = "request_id string, document_version_id string, field_code string, reviewed_by string, verified boolean, requested_at timestamp"


def test_report_approval_writes_and_goes_stale(spark):
    store = report_store(spark)
    rows = [("q1", "v2", "management_fee", "me", False, at(1)), ("q2", "v3", "management_fee", "me", False, at(2)), ("q3", "v2", "management_fee", "me", False, at(3)),
            ("q4", "v2", "repair_reserve_fee", "me", False, at(4)), ("q5", "v2", "repair_reserve_fee", " ", True, at(5)), ("q6", "v2", "balance", "me", True, at(6)), ("q7", "v3", "repair_reserve_fee", "me", True, at(7)),
            ("q8", "v2", "none", "me", True, at(8)), ("q9", "v7", "current_owner_name", "me", True, at(9))]
    requests = spark.createDataFrame(rows, REPORT)
    got = A.approve_report(requests, store)
    assert outcome(got) == {
        ("q1", "management_fee"): ("applied", None), ("q2", "management_fee"): ("refused", "Review is stale"), ("q3", "management_fee"): ("reused", None),
        ("q4", "repair_reserve_fee"): ("refused", "Resolve reading uncertainty before approval"), ("q5", "repair_reserve_fee"): ("refused", "Reviewer required"),
        ("q6", "balance"): ("refused", "Evidence required"), ("q7", "repair_reserve_fee"): ("refused", "Older or unknown reference date"),
        ("q8", "none"): ("refused", "Unit confirmation required"), ("q9", "current_owner_name"): ("refused", "Unit confirmation required")}
    assert {r.extracted_value_id: r.approved for r in got.changes["values"].collect()} == {"a1": False, "a2": True}
    assert {r.diff_id: (r.review_status, r.reviewed_by) for r in got.changes["diffs"].collect()} == {"x2": ("applied", "me")}
    assert {r.document_version_id: r.is_current for r in got.changes["versions"].collect()} == {"v2": True}  # v1 still holds an approved fee
    assert [(r.request_id, r.field_code) for r in got.changes["reviews"].collect()] == [("q1", "management_fee")]
    after = A.updated(store, got.changes)
    again = outcome(A.approve_report(requests, after))
    assert again["q1", "management_fee"] == ("reused", None) and again["q2", "management_fee"] == ("refused", "Review is stale")
    assert after["values"].count() == store["values"].count() and A.approve_report(requests, after).changes["values"].count() == 0


def test_report_request_is_all_or_nothing(spark):
    store = report_store(spark)
    rows = [("q1", "v2", "management_fee", "me", False, at(1)), ("q1", "v2", "repair_reserve_fee", "me", False, at(1)), ("q2", "v3", "management_fee", "me", False, at(2))]
    got = outcome(A.approve_report(spark.createDataFrame(rows, REPORT), store))
    assert got["q1", "management_fee"] == ("refused", "Another field of the request was refused") and got["q2", "management_fee"] == ("applied", None)
    verified = [(*r[:4], True, r[5]) for r in rows]
    got = A.approve_report(spark.createDataFrame(verified, REPORT), store)
    assert outcome(got)["q1", "management_fee"][0] == "applied" and outcome(got)["q2", "management_fee"] == ("refused", "Review is stale")
    assert {r.document_version_id: r.is_current for r in got.changes["versions"].collect()} == {"v1": False, "v2": True}


RULES = "request_id string, diff_id string, case_id string, action string, requested_at timestamp"


def test_rules(spark):
    store = report_store(spark)
    requests = spark.createDataFrame([("h", "y5", "k", "hold", at(0)), ("q1", "y5", "k", "adopt", at(1)), ("q2", "y5", "k", "adopt", at(2)), ("late", "y5", "k", "hold", at(3)),
                                      ("q3", "y6", "k", "adopt", at(4)), ("q4", "x2", "k", "adopt", at(5)), ("q5", "y5", "none", "adopt", at(6)), ("q6", "y5", "k", "other", at(7)), ("q7", "zz", "k", "adopt", at(8))], RULES)
    got = A.adopt_rules(requests, store)
    assert {k[0]: v for k, v in outcome(got).items()} == {
        "h": ("held", None), "q1": ("applied", None), "q2": ("reused", None), "late": ("reused", None), "q3": ("refused", "Evidence review required"),
        "q4": ("refused", "Case mismatch"), "q5": ("refused", "Case mismatch"), "q6": ("refused", "Evidence review required"), "q7": ("refused", "Case mismatch")}
    assert {r.extracted_value_id: r.approved for r in got.changes["values"].collect()} == {"r5": True}
    assert {r.diff_id: (r.review_status, r.reviewed_at) for r in got.changes["diffs"].collect()} == {"y5": ("applied", at(1))}
    after = A.updated(store, got.changes)
    assert outcome(A.adopt_rules(spark.createDataFrame([("z", "y5", "k", "adopt", at(9))], RULES), after))["z", "pet_restrictions"] == ("reused", None)


def test_pointer(spark):
    store = report_store(spark)
    requests = spark.createDataFrame([("q1", "p5", "k", "adopt", at(1)), ("q2", "p8", "k", "adopt", at(2)), ("q3", "p5", "e", "adopt", at(3)), ("q4", "x2", "k", "adopt", at(4)), ("q5", "p8", "k", "hold", at(5))], RULES)
    got = A.adopt_pointer(requests, store)
    assert {k[0]: v for k, v in outcome(got).items()} == {"q1": ("applied", None), "q2": ("refused", "Older source"), "q3": ("refused", "Case mismatch"), "q4": ("refused", "Case mismatch"), "q5": ("held", None)}
    assert [r.purchase_values for r in got.changes["cases"].collect()] == [{"pet_restrictions": "r5", "current_owner_name": "g7"}]
    assert {r.diff_id: r.review_status for r in got.changes["diffs"].collect()} == {"p5": "applied", "p8": "reviewed"}
    after = A.updated(store, got.changes)
    reset = A.updated(after, {"diffs": after["diffs"].filter("diff_id = 'p5'").withColumn("review_status", F.lit("unreviewed"))})
    assert outcome(A.adopt_pointer(requests.filter("request_id = 'q1'"), reset))["q1", "pet_restrictions"] == ("refused", "Review is stale")


def test_master(spark):
    store = report_store(spark)
    catalog = spark.createDataFrame([("current_owner_name", "unit"), ("management_fee", "unit"), ("pet_restrictions", "building")], "field_code string, entity_level string")
    requests = spark.createDataFrame([("q1", "g7", "u", "adopt", at(1)), ("q2", "g8", "u", "adopt", at(2)), ("q3", "x2", None, "adopt", at(3)), ("q4", "x3", "u", "adopt", at(4)), ("q5", "x3", "w", "adopt", at(5)), ("q6", "y5", None, "adopt", at(6))],
                                     "request_id string, diff_id string, unit_id string, action string, requested_at timestamp")
    got = A.adopt_master(requests, store, catalog)
    assert {k[0]: v for k, v in outcome(got).items()} == {"q1": ("applied", None), "q2": ("refused", "Master changed; reload"), "q3": ("applied", None), "q4": ("refused", "Master changed; reload"),
                                                          "q5": ("refused", "Unit mismatch"), "q6": ("refused", "Unit mismatch")}
    unit = got.changes["units"].collect()
    assert [(r.current_owner_name, int(r.management_fee), r.updated_at) for r in unit] == [("new", 120, at(3))]
    assert {r.extracted_value_id: r.approved for r in got.changes["values"].collect()} == {"g7": True, "a2": True, "a1": False}
    after = A.updated(store, got.changes)
    assert {k[0]: v[0] for k, v in outcome(A.adopt_master(requests, after, catalog)).items()} == {"q1": "reused", "q2": "refused", "q3": "reused", "q4": "refused", "q5": "refused", "q6": "refused"}


def test_commits_compare_and_set(spark, tmp_path):
    root, store = str(tmp_path / "store"), report_store(spark)
    tables = {**schemas.STORE, "baselines": A.BASELINES}
    assert commits.commit(spark, root, store, 0, whole=True) == 1
    opened, base = commits.open_store(spark, root, tables, A.KEYS)
    first = A.approve_report(spark.createDataFrame([("q1", "v2", "management_fee", "me", False, at(1))], REPORT), opened)
    second = A.approve_report(spark.createDataFrame([("q2", "v3", "management_fee", "me", False, at(2))], REPORT), opened)
    assert commits.commit(spark, root, first.changes, base) == 2
    with pytest.raises(commits.StaleHead):
        commits.commit(spark, root, second.changes, base)
    now, base = commits.open_store(spark, root, tables, A.KEYS)
    assert base == 2 and now["values"].count() == store["values"].count()
    assert sorted(r.extracted_value_id for r in now["values"].filter("approved and document_version_id in ('v1', 'v2', 'v3')").collect()) == ["a2", "b1"]
    assert outcome(A.approve_report(spark.createDataFrame([("q2", "v3", "management_fee", "me", False, at(2))], REPORT), now))["q2", "management_fee"] == ("refused", "Review is stale")
    before, _ = commits.open_store(spark, root, tables, A.KEYS, at=1)
    assert before["values"].filter("extracted_value_id = 'a2'").first().approved is False
    assert commits.commit(spark, root, {n: now[n] for n in tables}, base, whole=True) == 3
    assert commits.open_store(spark, root, tables, A.KEYS)[0]["diffs"].count() == store["diffs"].count()
    assert commits.head(spark, str(tmp_path / "nothing")) == 0 and commits.open_store(spark, str(tmp_path / "nothing"), tables, A.KEYS)[0]["values"].count() == 0


def test_changes_are_written_once_and_versions_looked_up_after_the_values(spark):
    store = workload_adoption._store(spark, "/root/testdata/sf0.001")
    for name in ("diffs", "documents"):  # policies read them several times
        assert not any(word in store[name]._jdf.queryExecution().optimizedPlan().toString() for word in ("Window", "Aggregate", "Join"))
    asked = spark.createDataFrame([(-1, "management_fee", "r")], "new_version_id long, field_code string, request_id string")
    (row,) = A._with_new_side(asked, store).collect()
    assert row.request_id == "r" and row.value_id is None and row.new_document_id is None


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:  # they go in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and rows.count() == 7
    assert spark.conf.get(FREE_SHUFFLES, None) is None


def test_decided_requests_leave_wide_columns_behind(spark):
    rows = [("q", "x", "a", at(1), "n", "ok"), ("q", "x", "a", at(1), "n", "ok"), ("r", "y", "a", at(2), "m", "ok"), ("s", "z", "b", at(3), "o", "held")]
    staged = spark.createDataFrame(rows, "request_id string, diff_id string, field_code string, requested_at timestamp, value_id string, stage string").withColumn("wide", F.lit("x" * 99))
    got = A._decide(staged, F.struct("field_code"), "stale", "wide")
    assert "wide" in got.columns and "wide" not in A._decide(staged, F.struct("field_code"), "stale").columns
    assert sorted((r.request_id, r.decision, r.reason, r.fresh) for r in got.collect()) == [
        ("q", "applied", None, True), ("q", "applied", None, True), ("r", "refused", "stale", False), ("s", "held", None, False)]  # one row each


def test_store_moves_its_readings_once(spark):
    store = workload_adoption._store(spark, "/root/testdata/sf0.001")
    for name in ("values", "diffs", "baselines"):
        assert not any(word in store[name]._jdf.queryExecution().optimizedPlan().toString() for word in ("Window", "Aggregate", "Join", "Repartition"))
    deal = order_values(spark, "/root/testdata/sf0.001", F.col("o_custkey") % 5)
    assert sorted(map(str, deal.drop("_dealt").collect())) == sorted(map(str, order_values(spark, "/root/testdata/sf0.001").collect()))
    ranked = deal.withColumn("n", F.row_number().over(Window.partitionBy("_dealt", "field_code").orderBy("version_id")))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pointer_of_a_case_that_is_there_twice(spark):
    store = report_store(spark)
    store["cases"] = store["cases"].unionByName(frame(spark, "cases", [dict(case_id="k", unit_id="u", purchase_values={"pet_restrictions": "gone"})]))
    rows = A._pointed(store).filter("case_id = 'k'").collect()
    assert [sorted(n.now_id for n in r._now) for r in rows] == [["g7", "r4"]] * 2
    assert len(A._pointed(store).collect()) == 3


def _shuffled(spark):
    """Rows written for shuffles by stage."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name, most", [("adopt_pointer", 25), ("adopt_rules", 30)])
def test_rows_moved_for_an_order(spark, name, most):
    """Where no join is broadcast: 18 and 22 rows; 33 and 57 while each lookup of the store moved its tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        workload_adoption.QUERIES[name][0](spark, "/root/testdata/sf0.001").collect()
        moved = sum(n for stage, n in _shuffled(spark).items() if stage > max(before, default=-1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < moved < most * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_best_rules_leave_out_any_one_version(spark):
    store = report_store(spark)
    value = dict(confidence=0.95, page_no=1, source_text="quote", approved=False)
    more = [{**value, "extracted_value_id": i, "document_version_id": v, "field_code": f, "value_json": j, **kw} for i, v, f, j, kw in [
        ("s4", "v4", "pet_restrictions", '"also"', {}), ("t6", "v6", "only", "1", {}), ("u5", "v5", "none_approved", "5", dict(approved=None)), ("u6", "v6", "none_approved", "6", {}), ("w1", "v1", "pet_restrictions", '"report"', {})]]
    store["values"] = store["values"].unionByName(frame(spark, "values", more))
    got = {r._bf: (r._bd, r._bv, r._bj, r._sj) for r in A._best_rules(store).collect()}
    assert got == {"pet_restrictions": ("m", "v4", '"no"', '"some"'), "only": ("m", "v6", "1", None), "none_approved": ("m", "v6", "6", "5")}
