"""Phrase collocations against counting every n-gram."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tricord.llm import collocations as co
from tricord.llm import queries


def plain(rows, least=100, longest=5, first=2000, inside=100):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    some = {x: c for x, c in counts.items() if c >= least}
    out = []
    for (lang, phrase), a in some.items():
        if len(phrase) < 2:
            continue
        cut = min((1000 * a * n[lang] // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
        around = [c for (other, longer), c in some.items() if other == lang and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))]
        if not any(100 * c >= inside * a for c in around):
            k = cut[1]
            out.append((lang, -cut[0], -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]], n[lang]))
    found, rank = set(), Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            found.add((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return found


def made(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "aa", "é", "é", "日本", "x\x0fy", "don't", "(in", "a"]
    fixed = ["new york city hall plan", "a a a a a a", "the of the of the", "日本 é é"]
    say = lambda: rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(0, 9)))
    return [(rng.choice(["en", "en", "en", None, "und", ""]), None if rng.random() < 0.02 else rng.choice(["", " ", "\t"]).join(["", rng.choice([". ", "\n", "!?", ", ", "\t", ""]).join(say() for _ in range(rng.randint(0, 6)))])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "x", 2) for lang, text in rows], "lang string, text string, n int, phrase string, score int")


@pytest.mark.parametrize("how", [{}, {"inside": 70, "longest": 4, "first": 9}, {"longest": 2}, {"size": 300}])
def test_collocations_are_those_of_all_ngrams(spark, how, monkeypatch):
    rows = made(400, 1)
    more = {k: v for k, v in how.items() if k != "size"}
    monkeypatch.setattr(co, "AT_ONCE", 500)
    got = co.collocations(frame(spark, rows).repartition(3), least=20, **how).collect()
    assert got and {tuple(r) for r in got} == plain(rows, least=20, **more) and len(got) == len({tuple(r) for r in got})


def test_counters_that_phrases_share_change_nothing(spark, monkeypatch):
    """With 16 counters nearly every phrase passes, and the result is the same."""
    rows = made(300, 2)
    counts = {(r["lang"], r["phrase"]): r["a"] for r in co.phrase_counts(frame(spark, rows), least=15, most=4)[0].collect()}
    assert counts == {(r["lang"], r["phrase"]): r["a"] for r in co.phrase_counts(frame(spark, rows), least=15)[0].collect()}
    monkeypatch.setattr(co, "WORD_BITS", 3)
    assert counts == {(r["lang"], r["phrase"]): r["a"] for r in co.phrase_counts(frame(spark, rows), least=15)[0].collect()}


def test_collocations_of_nothing_and_of_one_long_text(spark):
    assert co.collocations(frame(spark, [])).count() == 0 and co.collocations(frame(spark, [(None, None), ("en", "one two")])).count() == 0
    rows = [("en", "new york is here, " * 40_000)]
    got = {tuple(r) for r in co.collocations(frame(spark, rows), size=10_000).collect()}
    assert got == {("en", 1, "new york is here", 40_000, 40_000, 40_000, 160_000, 4000)}


def test_bitmaps_shift_over_blocks_and_stop_at_pieces():
    rng = np.random.default_rng(5)
    ids, begins = rng.integers(0, 4, 1000), rng.random(1000) < 0.1
    maps = co.Bitmaps(ids.astype(np.int64), np.arange(1000), begins, 4)
    phrase, word, block, bits = maps.extend(maps.word, maps.block, maps.bits)
    got = Counter()
    for p, w, n in zip(phrase, word, np.bitwise_count(bits), strict=True):
        got[int(p), int(w)] += int(n)  # of a batch that is all of the words
    assert got == Counter((int(ids[i]), int(ids[i + 1])) for i in range(999) if not begins[i + 1])


def test_words_with_one_code_are_told_apart(spark, monkeypatch):
    """A seed that gives a frequent word another word's code isn't used."""
    rows = [("en", "one two. " * 30 + "rare word")]
    cut = co.shards(frame(spark, rows))
    hash_ = co.F.xxhash64
    monkeypatch.setattr(co.F, "xxhash64", lambda *c: hash_(co.F.lit(1)) if "lit" not in str(c[0]) and "0" in str(c[0]) else hash_(*c))
    words = co._vocabulary(co.materialize(cut, "shards"), 20)[1].collect()
    assert {r["phrase"] for r in words} == {"one", "two"} and len({r["code"] for r in words}) == 2


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.queries()["op12_phrase_collocations"](spark, sf).toPandas()
    names = sorted(got.columns)
    want = con.execute(queries.oracle_sql()["op12_phrase_collocations"]).df()
    rows = lambda df: sorted(map(tuple, df[names].astype(object).values.tolist()))
    assert rows(got) == rows(want) and len(got) > 20
