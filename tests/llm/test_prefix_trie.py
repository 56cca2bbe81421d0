import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from colscope.llm.ordered import running
from colscope.llm.prefix_trie import prefix_tree, rebuild
from colscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    found = set()
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in below) for x in below)
        children = sum(len(x) == len(node) + 1 for x in below)
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(nodes[node[:-1]]) if node else None
        found.add((min(members), len(node), parent, len(members), children, leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return found


def tree(conversations):
    rows = [tuple(r[n] for n in NAMES) for r in prefix_tree(*rebuild(conversations)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_table_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {tuple(r[n] for n in NAMES) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()}
    assert found == brute_force(rows)


def test_shared_beginnings_copies_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in range(-7, 90):
        copy = c % 3 == 0  # a third of all conversations are the same
        for k in range(6 if copy else rng.randrange(0, 12)):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", "copy" if copy else rng.choice("abé")))
    rows += [(200, None, None, None), (200, 1, "user", None), (200, 1, "user", None), (200, 1, "user", "tie"), (200, 1, "a", "tie")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    found = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("size", F.lit(None).cast("int"))
    assert tree(found) == brute_force(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(5, k, "user", f"turn {k % 7}") for k in range(3000)] + [(6, k, "user", f"turn {k % 7}") for k in range(12)]
    found = {x[:7] for x in tree(spark.createDataFrame(rows, SCHEMA).repartition(16))}
    assert max(x[1] for x in found) == 3000
    root = next(x for x in found if x[1] == 0)
    # The second one shares its first turns with the first, as far as it has turns at all.
    assert root[:6] == (5, 0, None, 2, 1, 1) and root[6] == 12 * len("turn 0")
    assert next(x for x in found if x[1] == 12)[3] == 2 and next(x for x in found if x[1] == 13)[3] == 1


def test_ends_are_hashed_over_many_runs(spark):
    ids = spark.range(10, 5010, 5).selectExpr("id AS conv_id")
    turns = ids.selectExpr("conv_id", "1L AS depth", "unhex('00') AS turn_key", "3L AS size")
    found = {r["depth"]: r for r in prefix_tree(ids, turns).collect()}
    listed = ",".join(map(str, range(10, 5010, 5)))
    assert found[1]["ends_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert found[0]["ends_sha256"] == hashlib.sha256(b"").hexdigest() and found[0]["saved_tokens"] == 3 * 999


def test_nothing_and_a_turnless_conversation(spark):
    assert tree(spark.createDataFrame([], SCHEMA)) == set()
    ids = spark.createDataFrame([(4,), (9,)], "conv_id long")
    turns = spark.createDataFrame([], "conv_id long, depth long, turn_key binary, size long")
    found = prefix_tree(ids, turns).collect()
    assert [tuple(r) for r in found] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())]


def test_running_values_go_on_over_partitions(spark):
    rows = [(g, k, (g * 31 + k * 17) % 101) for g, n in ((1, 5), (2, 4000), (3, 1), (4, 300)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(7)
    found = running(df, "g", ["k"], {"total": ("sum", "v"), "bits": ("bit_xor", "v")})
    assert found.columns == ["g", "k", "v", "total", "bits"]
    totals, bits = defaultdict(int), defaultdict(int)
    expected = set()
    for g, k, v in rows:
        totals[g] += v
        bits[g] ^= v
        expected.add((g, k, v, totals[g], bits[g]))
    assert {tuple(r) for r in found.collect()} == expected
