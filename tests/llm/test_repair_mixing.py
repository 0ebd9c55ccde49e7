"""Conversation repair and source mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from tricord.llm import dialogue, mixing, queries

TURNS = "conv_id long, turn long, role string, text string, found string, copies_ int, EDIT string"


def best_plain(rows):
    """(cost, audit, repaired) by trying every edit from every place, over rows of (role, text, fault)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        for letter, role in (("u", "user"), ("a", "assistant")):
            if inserted < 2 and letter in step[q]:
                c, e, out = best(i, letter, inserted + 1)
                found.append((c + 2, "I" + e, ((role, ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, out = best(i + 1, q, 0)
            found.append((c + 3, "D" + e, out))
            if fault in ("fine", "truncated"):
                late = fault == "truncated"
                if role[:1] in step[q]:
                    c, e, out = best(i + 1, role[:1], 0)
                    found.append((c + late, "K" + e, ((role, text), *out)))
                for letter, new in (("u", "user"), ("a", "assistant")):
                    if letter in step[q]:
                        c, e, out = best(i + 1, letter, 0)
                        found.append((c + 2 + late, "R" + e, ((new, text), *out)))
        return min(found, default=(10**9, "~", ()))

    return best(0, "", 0)


def faults_plain(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "fine" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def repair_plain(turns):
    """Rows of repair_digest(damage(turns)) from (conv_id, turn, role, text) tuples."""
    some, damaged = {t[0] for t in turns}, defaultdict(list)
    for conv, turn, role, text in turns:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text), "user" if k == 4 else role
        damaged[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = set()
    for conv in some:
        rows = sorted(damaged[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        judged = faults_plain([(role, text) for _, role, text in rows])
        count = Counter(f for _, _, f in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = best_plain(tuple(judged)) if rows else (0, "", ())
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.add((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha))
    return out


def tangled(n, seed):
    rng = random.Random(seed)
    texts, roles = ["Well.", "So?", "and then", " \t", "", None, "Ünï!", "x" * 5000 + "."], ["user", "assistant", "system", "tool", None, "", "User"]
    return [(rng.choice([c, None]) if c % 9 == 0 else c, rng.choice([t, None, t // 2]) if t % 5 == 0 else t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 9))]


def test_repair_is_the_cheapest_of_all(spark):
    turns = tangled(150, 1)
    frame = spark.createDataFrame([(*t, "x", 1, "e") for t in turns], TURNS)
    got = dialogue.repair_digest(dialogue.damage(frame))
    assert {tuple(r) for r in got.collect()} == repair_plain(turns) and got.count() == len({t[0] for t in turns})


def test_repair_of_classes_is_the_cheapest_of_all():
    machine, rng = dialogue.Determinised(), random.Random(2)
    name = {0: "s", 1: "u", 2: "a", 3: "x"}
    faults = ("fine", "truncated", "duplicate", "blank")
    for _ in range(400):
        kinds = bytes(rng.randrange(16) for _ in range(rng.randrange(9)))
        rows = tuple((name[k >> 2], "t", faults[k & 3]) for k in kinds)
        assert machine.repair(kinds) == best_plain(rows)[:2]
    assert len(machine.vectors) < 60  # states come from differences that repairs bound
    cost, audit = machine.repair(bytes([4, 8] * 200_000 + [4]))
    assert (cost, len(audit)) == (2, 400_002)


def test_repaired_rows_follow_the_grammar(spark):
    turns = spark.createDataFrame([(*t, "x", 1, "e") for t in tangled(80, 3)], TURNS)
    found = {r["conv_id"]: r["audit"] for r in dialogue.audits(turns).collect()}
    rows = defaultdict(list)
    for r in dialogue.repair(turns).collect():
        rows[r["conv_id"]].append(r)
    for conv, audit in found.items():
        kept = sorted((r for r in rows[conv] if r["edit"] != "D"), key=lambda r: r["place"])
        assert [r["place"] for r in kept] == list(range(len(kept)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in kept))
        assert Counter(audit) == Counter(r["edit"] for r in rows[conv])
        assert all(r["text"] == "" for r in kept if r["edit"] == "I")


def test_repair_of_a_long_conversation_and_of_none(spark):
    n = 20_000
    long = spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(" said.")).alias("text"))
    row = dialogue.repair_digest(long).first()
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:{i} said." for i in range(n))
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "K" * n, hashlib.sha256(text.encode()).hexdigest())
    assert dialogue.repair_digest(long.limit(0)).count() == 0 and dialogue.repair(long.limit(0)).count() == 0
    dropped = dialogue.repair_digest(long.limit(3).withColumn("copies", F.lit(0))).collect()
    assert [tuple(r) for r in dropped] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# 13

def mix_plain(rows, weights=(5, 2, 1), share=Fraction(3, 2), repeats=2):
    """{source: (size, target)} with exact fractions, one source capped after another."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, free = {}, share * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > repeats * sizes[s]}
        if not over:
            return sizes, target | {s: rest * weight[s] / total for s in free}
        target |= {s: Fraction(repeats * sizes[s]) for s in over}
        rest, free = rest - sum(target[s] for s in over), free - over
    return sizes, target


def check_mix(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], "doc_id long, text string, source string, SIZE int, Copies string, hash string")
    got = mixing.mix(frame, **how).select("doc_id", "text", "source", "size", "source_size", "target", "copies", "taken", "hash").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(frame.repartition(7), **how).select(got[0].__fields__).collect())) if got else not rows
    sizes, target = mix_plain(rows, **how)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    taken, largest, groups = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == float(target[r["source"]]) and 0 <= r["copies"] <= how.get("repeats", 2) and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
        groups[r["source"], r["doc_id"], r["text"]] += r["size"]
    for (source, _, _), n in groups.items():
        largest[source] = max(largest[source], n)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6, source
    return got


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    sources = [None, "", "z", "é", "a b", "Z", *[f"s{k}" for k in range(12)]]
    rows = [(i, " w\n" * rng.randint(0, 60), "z" if rng.random() < 0.4 else rng.choice(sources)) for i in range(1500)]
    rows += [(None, None, "only null"), (None, "", None), (7, "w " * 3000, "one document"), (7, "w " * 3000, "one document"), (9, "again w", "z")]
    check_mix(spark, rows)
    check_mix(spark, rows, share=Fraction(3, 10))
    check_mix(spark, rows, share=Fraction(5, 1), repeats=3)


def test_mix_of_few_rows(spark):
    check_mix(spark, [])
    check_mix(spark, [(1, None, None)])
    check_mix(spark, [(1, "a b c", "x"), (2, "", "x"), (3, "d", "x")])


def test_larger_budgets_keep_what_smaller_ones_take(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 17) + 1)").alias("text"), F.lit("x").alias("source"))
    small, large = ({r["doc_id"]: r["copies"] for r in mixing.mix(rows, share=s).collect()} for s in (Fraction(1, 3), Fraction(5, 3)))
    assert all(small[i] <= large[i] for i in small) and set(small.values()) == {0, 1} and set(large.values()) == {1, 2}
    assert mixing.repeated(mixing.mix(rows, share=Fraction(5, 3))).count() == sum(large.values())


def test_boundary_buckets_are_split_to_single_hashes(spark):
    """Hashes that agree in 48 bits are told apart in the last round."""
    sizes = spark.createDataFrame([("x", 10, (123 << 12) + k) for k in range(100)] + [(None, 4, 5)] * 3, "source string, size long, hash long")
    aims = spark.createDataFrame([("x", 1000, 355.0), (None, 12, 5.0)], "source string, source_size long, target double")
    got = {r["source"]: r["threshold"] for r in mixing.thresholds(sizes, aims).collect()}
    assert got == {"x": (123 << 12) + 34, None: 4}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_source_mixing"])
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf).toPandas()
    names = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name]).df()
    key = lambda df: sorted(map(tuple, df[names].astype(object).values.tolist()))
    assert key(got) == key(want)
