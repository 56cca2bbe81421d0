import hashlib
from collections import Counter

from pyspark.sql import functions as F

from colscope.llm import fixity
from colscope.llm.fixity import audit, leaves, parents, ranges
from colscope.llm.queries import QUERIES, archived


def records(spark, rows):
    return spark.createDataFrame(rows, "archive string, offset long, record binary")


def test_roots_by_hand(spark):
    rows = [("a", k * 30_000, bytes([k]) * 10) for k in range(10)]
    line = lambda o, r: f"{o:>20}:{len(r)}:{hashlib.sha256(r).hexdigest()}"
    by = {}
    for _, o, r in rows:
        by.setdefault(o // fixity.RANGE, []).append(line(o, r))
    low = {n: hashlib.sha256(",".join(x).encode()).hexdigest() for n, x in by.items()}
    nodes = ranges(leaves(records(spark, rows)))
    assert {r["node"]: r["sha256"] for r in nodes.collect()} == low
    root = hashlib.sha256(",".join(f"{n:>20}:{h}" for n, h in sorted(low.items())).encode()).hexdigest()
    assert [r["sha256"] for r in parents(nodes).collect()] == [root]


def test_query_by_brute_force(spark, sf):
    rows = archived(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    found = {(int(r["archive"]), r["offset"]): r["status"] for r in QUERIES["op3_merkle_fixity"](spark, sf).collect()}
    assert found == {
        (r["archive"], r["offset"]): "missing" if r["page_id"] % 211 == 7 else
        "corrupt" if r["sha256"] != r["held_sha256"] else "match"
        for r in rows
    }
    assert {"corrupt", "missing", "match"} <= set(found.values())
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows:
        url, html = pages[r["page_id"]]["url"] or "", pages[r["page_id"]]["html"] or ""
        for body, sha in ((html, r["sha256"]), (html.replace("<", ">") if r["page_id"] % 97 == 5 else html, r["held_sha256"])):
            head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n"
            record = f"{head}{body}\r\n\r\n".encode()
            assert sha == hashlib.sha256(record).hexdigest() and r["length"] == len(record)


def test_odd_rows(spark):
    left = [("a", 0, b"x"), ("a", 0, b"x"), ("a", 5_000_000, b"far"), (None, None, None), ("gone", 0, b"z"), ("b", 7, b"same")]
    right = [("a", 0, b"x"), ("a", 5_000_000, b"FAR"), (None, None, None), ("new", 1, b"n"), ("b", 7, b"same")]
    wide = lambda rows: records(spark, rows).withColumn("sha256", F.lit("clash")).withColumn("status", F.lit(1))
    found = sorted((str(r["archive"]), r["offset"], r["status"]) for r in audit(wide(left), wide(right)).collect())
    assert found == [
        ("None", -1, "match"), ("a", 0, "match"), ("a", 0, "missing"), ("a", 5_000_000, "corrupt"), ("b", 7, "match"),
        ("gone", 0, "missing"), ("new", 1, "extra"),
    ]
    nothing = records(spark, [])
    assert audit(nothing, nothing).count() == 0
    assert {r["status"] for r in audit(nothing, records(spark, right)).collect()} == {"extra"}


def test_pages_without_or_with_repeated_ids(spark, tmp_path):
    rows = [(None, "u", "<a>"), (None, "u", "<b>"), (3, "v", "<c>"), (3, "v", "<c>"), (3, "v", "<dd>"), (7, "w", "<e>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = archived(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()
    assert len(found) == len(rows)
    for archive in (None, 0):
        at = 0
        for r in sorted((r for r in found if r["archive"] == archive), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    audited = [(r["archive"], r["status"]) for r in QUERIES["op3_merkle_fixity"](spark, str(tmp_path)).collect()]
    assert sorted(audited, key=str) == sorted([(None, "match")] * 2 + [("0", "match")] * 3 + [("0", "missing")], key=str)


def test_all_offsets_null_and_many_copies(spark):
    left = [("a", None, bytes([k % 3])) for k in range(900)] + [(None, None, b"n")] * 50
    right = [("a", None, bytes([k % 3])) for k in range(897)] + [("a", None, b"odd")] + [(None, None, b"n")] * 52
    found = Counter((r["archive"], r["offset"], r["length"], r["status"]) for r in audit(records(spark, left), records(spark, right)).collect())
    assert found == {
        ("a", -1, 1, "match"): 897, ("a", -1, 1, "corrupt"): 1, ("a", -1, 1, "missing"): 2, (None, -1, 1, "match"): 50, (None, -1, 1, "extra"): 2,
    }
    same = records(spark, left)
    assert {r["status"] for r in audit(same, same.repartition(5)).collect()} == {"match"}
