"""The training-data operators against plain versions, round trips and edge cases."""

import hashlib
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tricord.llm import chat, common, decontaminate, embeddings, html_text, jaccard, language, packing, queries, token_records, toxicity, warc

DOCS = "doc_id long, text string, lang string, k int, n int, a string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "Ünï çé 123 !?"), (7, "long word " * 30_000), (7, "again the same id"), (None, "no id at all here now")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated ids, and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, 1, 2, "x") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def encode(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# 1

def test_token_records_are_those_of_the_tokenizer(spark, docs):
    of, start = encode("word_bpe_49k.json"), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_records.token_digest(spark, docs, queries.tokenizer_path("word_bpe_49k.json")).collect()}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*of(r["text"]), 1]
        assert got[r["doc_id"]] == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_records_of_odd_rows_and_damage(spark, odd):
    got = token_records.token_digest(spark, odd, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["n_tokens"] for r in got}[1] == 1
    assert token_records.token_digest(spark, odd.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0
    frame = bytearray(token_records.frame(b"some payload"))
    assert bytes(token_records.unframe(bytes(frame))[0]) == b"some payload"
    for k in range(len(frame)):
        bad = frame.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_is_whole_encoding(name):
    texts = ["", "  a  b ", "it's 12,5% <|endoftext|> Ünïcode x y", "a\n\n b\t\tc \n", "x" * 5000, "don't, won't; 3rd-party... ¿qué? «oui»", "日本語 and ру́сский 🙂🙂", "\x1c\x1d a\x85b"]
    e = common.ChunkEncoder(queries.tokenizer_path(name))
    of = encode(name)
    for t, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, dtype=e.type).tolist() == of(t), t


def test_words_that_come_back_after_many_others_are_still_known():
    e, calls = common.ChunkEncoder(queries.tokenizer_path("byte_bpe_50k.json")), [0]
    tokenize = e.tokenize

    def counted(word):
        calls[0] += 1
        return tokenize(word)

    e.tokenize = counted
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" " + " ".join(a + b + c + d for b in letters for c in letters) for a in letters for d in letters[:10]]  # 175,760 words
    first = [x for t in texts for x in e.encode([t])]
    assert calls[0] == 26**3 * 10
    assert [x for t in texts for x in e.encode([t])] == first and calls[0] == 26**3 * 10


# 2

def test_decontamination(spark):
    words = [f"w{k}" for k in range(30)]
    item = " ".join(words)
    edited = words.copy()
    edited[7] = edited[19] = "other"
    rows = [(1, f"before {item.upper()} after"), (2, f"x y z {' '.join(edited)} more"), (3, " ".join(f"v{k}" for k in range(50))), (4, None), (5, ""), (6, f"a b c {' '.join(words[:6])}"), (None, item)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, leaking_id int")
    bench = spark.createDataFrame([(9, item), (10, item), (11, None), (12, "too short"), (13, "...")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["position"], r["matched"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {1: (9, 1, 30), 2: (9, 3, 28), None: (9, 0, 30)}
    kept = decontaminate.without_leaks(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6} and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def leaks_plain(docs, items, masks=decontaminate.MASKS):
    """[{item: (score, matched, -position)} of each document], every window of a text looked up among those of all items."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    span, least, windows, out = max(map(len, masks)), {}, defaultdict(list), []
    for i, t in items:
        if split(t):
            least[tuple(split(t))] = min(i, least.get(tuple(split(t)), i))
    for item in least:
        for mask in masks if len(item) >= span else ("1" * len(item),):
            for q in range(len(item) - len(mask) + 1):
                windows[mask, tuple(item[q + k] for k, c in enumerate(mask) if c == "1")].append((item, q))
    kinds = {m for m, _ in windows}
    for _, t in docs:
        text, at, found = split(t), set(), {}
        for mask in kinds:
            for p in range(len(text) - len(mask) + 1):
                at |= {(item, p - q) for item, q in windows.get((mask, tuple(text[p + k] for k, c in enumerate(mask) if c == "1")), ())}
        for item, p in at:
            equal = [0 <= p + k < len(text) and text[p + k] == w for k, w in enumerate(item)]
            now = best = 0
            for e in equal:
                now = max(0, now + (1 if e else -2))
                best = max(best, now)
            if sum(equal) >= 0.7 * len(item) or best >= 10:
                found[least[item]] = max(found.get(least[item], (0,)), (best, sum(equal), -p))
        out.append(found)
    return out


def test_decontamination_is_that_of_all_windows(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 12, n)]
    items = [(k, " ".join(word(int(rng.integers(1, 25))))) for k in range(25)] + [(99, items_text) for items_text in ("w1 w2", "W1, w2")]
    docs = []
    for k in range(60):
        own, planted = word(int(rng.integers(0, 40))), items[rng.integers(0, 25)][1].split()
        for _ in range(rng.integers(0, 4)):
            planted[rng.integers(0, len(planted))] = "other"
        docs.append((k, " ".join(own[:5] + planted + own[5:])))
    docs += [docs[0], (200, "w1 w2"), (201, "a w1 w2 b"), (202, "w2 w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["matched"], -r["position"]) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): best for (d, _), found in zip(docs, leaks_plain(docs, items)) for i, best in found.items()}
    assert got == want and len({i for _, i in want if len(dict(items)[i].split()) < 7}) > 3 and any(d == 201 for d, _ in want)


def test_decontamination_of_long_repeating_texts(spark):
    phrase = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"{phrase} " * 3000), (2, "w3 " * 40_000), (2, "w3 " * 40_000)], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, f"{phrase} {phrase}"), (2, "w3 " * 9)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["position"], r["matched"]) for r in got} == {(1, 1, 0, 40), (2, 2, 0, 9)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.queries()[name](spark, sf).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_planted_benchmark_items_are_found(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {r["doc_id"] for r in decontaminate.leaks(docs, bench).select("doc_id").collect()}
    items = [" ".join(re.findall(r"\w+", b["text"].lower())) for b in bench.collect()]
    for r in docs.where("text IS NOT NULL").collect():
        own = " ".join(re.findall(r"\w+", r["text"].lower()))
        if any(f" {i} " in f" {own} " for i in items):
            assert r["doc_id"] in found


# 3

def links_of(x, labels, threshold=0.93):
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    return [(i, j) for i in range(len(x)) for j in range(i) if labels[i] is not None and labels[i] == labels[j] and n[i] and n[j] and u[i] @ u[j] >= threshold]


def least(n, links):
    c = list(range(n))
    while True:
        new = c.copy()
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == c:
            return c
        c = new


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    x = centres[rng.integers(0, 20, 300)] + rng.normal(size=(300, 8)) * 0.15
    x[10] = x[11] = x[12]
    x[13] = 0
    labels = [None if k == 20 else str(k % 2) for k in range(300)]
    rows = [(k, [float(v) for v in x[k]], labels[k]) for k in range(300)]
    rows += [(300, None, "0"), (301, [], "0"), (302, [1.0, None, *[0.0] * 6], "0"), (303, [float("nan")] * 8, "0"), (304, [1.0], "1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label string, cell int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    links = links_of(x, labels)
    degree, c = np.bincount(np.array(links).ravel(), minlength=300), least(300, links)
    found = sum(got[k]["n_links"] for k in range(300))
    assert len(got) == 305 and found >= 0.9 * degree.sum() and all(got[k]["n_links"] <= degree[k] for k in range(300))
    assert np.mean([got[k]["component_id"] == c[k] for k in range(300)]) > 0.95
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(300, 305))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_on_a_large_grid(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOVE", 2)  # as if visits were cheap: a fine grid on few vectors
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(900, 16))
    x = centres[rng.integers(0, 900, 4000)] + rng.normal(size=(4000, 16)) * 0.18
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.05  # a large group of near copies
    x[300:600] = x[300]  # and of exact ones
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame([(k, x[k].tolist(), "a") for k in range(len(x))], "vec_id long, embedding array<double>, label string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    asked = np.arange(0, len(x), 50)
    assert all(got[k] <= links[k] for k in range(len(x))) and sum(got[k] for k in asked) >= 0.9 * links[asked].sum()
    other = [k for k in asked if k >= 600]
    assert sum(got[k] for k in other) >= 0.9 * links[other].sum() > 0
    grid = embeddings.cheapest_grid(u, len(u), 0.93, 0.99)
    assert len(grid.books[0]) > 8 and grid.visits < len(grid.books[0]) ** 2


def test_embeddings_of_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 3)  # so that blocks of both sides meet
    rows = [(5, [1.0, 0.0], "a"), (5, [1.0, 0.0], "a"), (7, [2.0, 0.0], "a"), (None, [3.0, 0.1], "a"), (9, [0.0, 1.0], "a"), (9, [1.0, 0.05], "a"), (3, [1.0, 0.0], "b")]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, pid int, at int")).collect()), key=repr)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (None, 3, 5, False), (9, 0, 9, True), (9, 3, 5, False), (3, 0, 3, True)], key=repr)
    many = spark.createDataFrame([(k, [1.0, k / 1000], "a") for k in range(40)], "vec_id long, embedding array<double>, label string")
    assert {(r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(many).collect()} == {(39, 0)}


def test_spanning_edges_connect_what_hits_do():
    rng = np.random.default_rng(0)
    for _ in range(20):
        hits = rng.random((12, 9)) < 0.12
        edges = embeddings.spanning_edges(hits)
        want = least(21, [(i, 12 + j) for i, j in np.argwhere(hits)])
        assert least(21, edges) == want and len(edges) == 21 - len(set(want))


def test_cells_come_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    sums = [a[i] + b[j] for i, j in embeddings.multi_sequence(a, b)]
    assert len(sums) == 6 and sums == sorted(sums)


# 4

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard_plain(rows):
    sets, holders, links = [shingles(t) for _, t in rows], defaultdict(list), []
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(k)
        links += [(k, j) for j, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    place = {k: p for p, k in enumerate(order)}
    c = least(len(rows), [(place[a], place[b]) for a, b in links])
    return {rows[k][0]: (len(sets[k]), rows[order[c[place[k]]]][0]) for k in range(len(rows))}


def test_jaccard_is_exact(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 500)}"
    base = [[word() for _ in range(80)] for _ in range(6)]
    rows = []
    for k in range(150):
        t = base[k % 6].copy()
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(0, 80)] = word()
        rows.append((k * 3 + 1, " ".join(t)))
    rows += [(1000 + k, " ".join(word() for _ in range(30)) + " " + " ".join(base[0][:40])) for k in range(20)]
    rows += [(2000, None), (2001, " "), (2002, "a b"), (2003, "A  b"), (2004, "a b c")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, k string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == jaccard_plain(rows)
    kept = jaccard.one_of_each(df)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()} and kept.columns == df.columns


def test_jaccard_of_hot_lists_is_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "PART", 7)
    monkeypatch.setattr(jaccard, "BLOCK_GROUPS", 5)
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(9)]
    rows = [(k, " ".join(passages[j] for j in rng.permutation(9)[: rng.integers(4, 9)]) + f" own{k % 7}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, hot=3).collect()}
    assert got == jaccard_plain(rows)


def test_jaccard_of_a_repeated_id(spark):
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(500):
        t = base.copy()
        t[rng.integers(0, 60)] = f"x{k}"
        rows.append((7 if k % 5 else k, " ".join(t)))
    rows += [rows[1]] * 50 + [(1000, "nothing like them at all here")]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and set(got) == {(i, 0 if i < 1000 else 1000) for i, _ in rows}
    kept = jaccard.one_of_each(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, KEPT int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1000] and kept.columns == ["doc_id", "text", "KEPT"]


def test_jaccard_of_odd_rows(spark, odd):
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()]
    assert len(got) == len(ODD) and dict(got)[5] == 4 and dict(got)[None] is None
    assert jaccard.one_of_each(odd).where("doc_id IS NULL").count() == 1
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0


# 5

def test_warc_round_trip(spark):
    pages = [(1, "http://a/é", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "\r\n\r\nWARC/1.1\r\n" * 3000), (6, "http://f", "ünï")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int")
    out = common.shared_dir(spark, "warc-test")
    got = {r["page_id"]: r for r in warc.read_warc(warc.write_warc(df, out), out).collect()}
    assert [got[k]["record_type"] for k in range(1, 7)] == ["revisit", "response", "revisit", "response", "response", "response"]
    assert (got[1]["refers_to"], got[3]["refers_to"], got[2]["refers_to"]) == (2, 4, None)
    for i, _, html in pages:
        assert got[i]["payload_bytes"] == len((html or "").encode()) and got[i]["payload_digest"] == warc.sha1_base32((html or "").encode())
    out = common.shared_dir(spark, "warc-test")
    assert warc.read_warc(warc.write_warc(df.limit(0), out), out).count() == 0


def test_warc_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    pages = [(None if k % 50 == 3 else int(k), f"http://x/{k}", None if k % 40 == 1 else "<p>" + "ab"[k % 2] * int(rng.integers(0, 12))) for k in rng.permutation(400)]
    pages += [pages[0], (9999, "http://l", "long " * 400_000)] + [(777, "u", "<p>same</p>")] * 3
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    for least_size in (0, 8):
        out = common.shared_dir(spark, "warc-test")
        manifest = warc.write_warc(df.repartition(6), out, min_revisit=least_size)
        read = warc.read_warc(manifest, out, with_payload=True)
        assert read.rdd.getNumPartitions() == manifest.count()
        got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect()), key=repr)
        largest = {}
        for i, _, h in pages:
            if i is not None:
                largest[h or ""] = max(i, largest.get(h or "", i))
        want = []
        for i, _, h in pages:
            data, first = (h or "").encode(), largest.get(h or "")
            to = first if len(data) >= least_size and i != first else None
            want.append((i, len(data), warc.sha1_base32(data), "response" if to is None else "revisit", to))
        assert got == sorted(want, key=repr)


# 6

def leaves(node, path=()):
    """(share, conditions) of a tree's leaves; a condition is (feature, whether at most, limit)."""
    if node.low is None:
        yield node.share, path
    else:
        name = html_text.FEATURES[node.feature]
        yield from leaves(node.low, (*path, (name, True, node.limit)))
        yield from leaves(node.high, (*path, (name, False, node.limit)))


def test_tree_looks_at_neighbours():
    content = [path for share, path in leaves(html_text.grow(html_text.labelled_table())) if share >= 0.5]
    assert {"density_before", "words_after"} <= {name for path in content for name, _, _ in path}
    # no leaf calls furniture content, whatever stands before it
    for path in content:
        assert ("element", True, 0.5) in path and any(name == "named" and low and limit < 0.5 for name, low, limit in path)


FURNITURE = ("<footer>{}</footer>", "<nav>{}</nav>", "<aside class=sidebar>{}</aside>", "<div class=cookie-notice>{}</div>", "<form>{}</form>", "<div id=comments>{}</div>", "<div class='ad'>{}</div>", "<div role=complementary>{}</div>", "<div class=share>{}</div>", "<section class=related-posts>{}</section>")


@pytest.mark.parametrize("n", [10, 60, 200])
def test_furniture_after_paragraphs_of_any_length(n):
    tree, text = html_text.grow(html_text.labelled_table()), " ".join(["x"] * n)
    for outer in FURNITURE:
        for inner in ("<a>F</a> <a>F F</a>", "<p>F F F</p>", "<p><a>F F F F F F F F F</a></p><p>F F F F F F F F F F F F F F F F F F F F</p>", "<ul><li><a>F</a><li><a>F</a></ul>", "<p>F F F F F F F F F F F F <a>F F</a></p>"):
            part = outer.replace("{}", inner)
            for page in (f"<article><p>{text}</p></article>{part}", f"<article><p>{text}</p>{part}<p>x x</p></article>", f"{part}<main><h1>x</h1><p>{text}</p></main>"):
                assert html_text.main_text(page, tree).split() == ["x"] * len([t for t in re.sub("<[^>]*>", " ", page).split() if t == "x"]), page


@pytest.mark.parametrize("n", [3, 20, 60, 200])
def test_linked_text_of_an_article_stays(n):
    tree, text = html_text.grow(html_text.labelled_table()), " ".join(["x"] * n)
    for page in (f"<article><p>{text}</p><p><a>x x x x</a></p><p>{text}</p></article>", f"<article><p><a>x x x x x x</a> x</p><p>{text}</p></article>", f"<article><p>{text}</p><p><a>x x</a></p></article>",
                 f"<article><p>{text} <math><mi>x</mi></math></p></article>", f"<article><div class=notice-of-award><p>{text}</p><p>x x</p></div></article>"):
        assert len(html_text.main_text(page, tree).split()) == len(re.sub("<[^>]*>", " ", page).split()), page


def test_given_pages_against_a_plain_extraction(sf):
    """Every given page has one article element: its text between block tags, by regular expressions."""
    from html import unescape

    tree = html_text.grow(html_text.labelled_table())
    for (page,) in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall():
        inside = re.search(r"<article>(.*)</article>", page or "", re.S)
        text = re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", inside[1] if inside else "", flags=re.S | re.I).replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"</?(b|i|em|a|span|strong)\b[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|td)\b[^>]*>", text)]
        assert html_text.main_text(page, tree) == "\n".join(x for x in parts if x)


def test_features_of_blocks():
    page = "<div class=menu><a href=/>Home page</a></div><h2>One two</h2><p>a b <a>c</a> d</p><ul><li>x<li><a>y z</a></ul><footer>f</footer>"
    rows = html_text.block_features(html_text.blocks(page)).tolist()
    own = [(2, 1.0), (2, 0), (4, 0.25), (1, 0), (2, 1.0), (1, 0)]
    rest = [(1, 0, 1, 0, 0), (1, 0, 0, 1, 0), (1, 0, 0, 0, 0), (1, 0, 0, 0, 1), (1, 0, 0, 0, 1), (1, 1, 0, 0, 0)]
    assert rows == [[*own[k], *(own[k - 1] if k else (0, 0)), *(own[k + 1] if k < 5 else (0, 0)), *rest[k]] for k in range(6)]


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<ul><li>" * 50_000 + "</ul>" * 50_000, "<p" * 100_000, "<!-- " * 50_000, '<a title="' * 50_000, "&amp;" * 200_000, "<script>" * 50_000])
def test_large_and_deep_pages_take_one_pass(page):
    began = time.time()
    html_text.main_text(page, html_text.grow(html_text.labelled_table()))
    assert time.time() - began < 20


def test_long_page_is_whole():
    text = html_text.main_text("<nav><a>n</a></nav><article>" + "<p>some words of the article here</p>" * 50_000 + "</article>", html_text.grow(html_text.labelled_table()))
    assert text == "\n".join(["some words of the article here"] * 50_000)


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>
    <article><h1>A heading &amp; more</h1><p>The first paragraph of the article, which has a good number of words in it
    and goes on over   lines.</p><script>var x = "<p>no</p>";</script><p>A second one &lt;here&gt; with more words that are part of the text as well.</p></article>
    <aside class=sidebar><p><a href=x>Related story one</a> <a href=y>Related story two</a></p></aside><footer><p>Copyright 2024 All rights reserved</p></footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (4, "w", "<p>unclosed <script>x", 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    want = "The first paragraph of the article, which has a good number of words in it and goes on over lines.\nA second one <here> with more words that are part of the text as well."
    assert got[1].endswith(want) and "Home" not in got[1] and "Copyright" not in got[1] and "Related" not in got[1] and "var x" not in got[1]
    assert got[2] == got[3] == "" and html_text.extract_text(df.limit(0)).count() == 0


# 7

def test_toxicity_is_learned(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit_toxicity(docs, labels)
    found = toxicity.predict_toxicity(docs, chain)
    both = found.join(labels, "doc_id").select("toxic", "is_toxic").collect()
    assert np.mean([bool(r["toxic"]) == r["is_toxic"] for r in both]) > 0.9
    assert not any(r["is_toxic"] for r in toxicity.predict_toxicity(odd, chain).where("doc_id < 4").collect())
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.predict_toxicity(docs, none).where("is_toxic").count() == 0


def test_toxicity_without_words_is_never_toxic(spark):
    rows = [(k, "vile " * 3 if k % 10 else "kind words only") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit_toxicity(docs, spark.createDataFrame([(k, 1, int(k % 10 > 0)) for k in range(400)], "doc_id long, quality int, toxic int"))
    asked = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, " 12 !", 0.5), (4, "vile", 0.5), (5, "kind words", 0.5)], "doc_id long, text string, p_toxic double")
    got = {r["doc_id"]: r for r in toxicity.predict_toxicity(asked, chain).collect()}
    assert [got[k]["is_toxic"] for k in range(1, 6)] == [False, False, False, True, False] and got[1]["p_toxic"] == got[3]["p_toxic"] == 0.0


def test_toxicity_without_texts_gives_numbers(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    chain = toxicity.fit_toxicity(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(50, 90)], "doc_id long, quality int, toxic int"))
    for r in toxicity.predict_toxicity(docs, chain).collect():
        assert all(0 <= r[f"p_{c}"] <= 1 for c in toxicity.CATEGORIES) and not r["is_toxic"]


def test_toxicity_sample_is_bounded_by_documents(spark, monkeypatch):
    rows = [(k % 20, f"word{k % 20} text number {k}") for k in range(3000)]
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, *more: seen.append(x.n) or toxicity.no_chain(tuple(toxicity.CATEGORIES)))
    toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int"))
    assert seen == [20]


def test_chain_feeds_probabilities_and_decides_last():
    rng = np.random.default_rng(1)
    n = 600
    y = (rng.random(n) < 0.4).astype(float)
    rows, of = np.arange(n, dtype=np.int32), np.where(y > 0, 5, 9).astype(np.int32)
    labels = np.column_stack([y, np.where(rng.random(n) < 0.9, y, 1 - y)])
    chain = toxicity.fit_chain(toxicity.Rows(rows, of, n), labels, np.ones(n), ("first", "last"))
    assert [len(m.chained) for m in chain.models] == [0, 1]
    sums = np.array([[2.0, -1.0]])
    first = toxicity.sigmoid(sums[:, 0] + chain.models[0].bias)
    assert np.allclose(chain.probabilities(sums)[0], [first[0], toxicity.sigmoid(sums[0, 1] + first[0] * chain.models[1].chained[0] + chain.models[1].bias)])
    assert list(toxicity.CATEGORIES)[-1] == "toxic"


# 8

def test_chat_of_a_very_long_text(spark):
    text = "<word> \\" * 200_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    r = chat.conversation_digest(chat.format_conversations(df)).first()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_chat_round_trip(spark):
    hostile = [r"\### Assistant: </turn> ok", "<turn user>\n</turn>\n", "\\b\\l\\g", "", None]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hostile)] + [(2, 0, "system", "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, at int")
    formatted = chat.format_conversations(df)
    turns = formatted.where("conv_id = 1").select(chat.parse(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", hostile[0]), ("assistant", hostile[1]), ("assistant", "tie"), ("user", hostile[2]), ("assistant", ""), ("user", "")]
    examples = chat.expand(formatted).where("conv_id = 1").orderBy("turn").collect()
    assert len(examples) == 3 and examples[1]["target"] == "tie" and examples[1]["prompt"].endswith("<turn assistant>\n")
    assert formatted.count() == 3 and chat.format_conversations(df.limit(0)).count() == 0


def test_chat_digest_reads_written_out_examples(spark):
    texts = ["hi <b>", "one \\ two", "", "three </turn> four", "bye", "five"]
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "y")], "conv_id long, turn int, role string, text string")
    lone = chat.conversation_digest(chat.format_conversations(df.union(df.where("conv_id IS NULL")).union(df.where("conv_id IS NULL")))).where("conv_id IS NULL").collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in lone] == [(1, 1)] * 3
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.conversation_digest(formatted).collect()}
    want = {1: "".join(texts[1::2]), 2: "", None: "y"}
    assert {k: (r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in want.items()}

    def moved(turn, context, target):
        return formatted.withColumn("examples", F.transform("examples", lambda e: F.struct((e["turn"] + turn).alias("turn"), (e["context_chars"] + context).alias("context_chars"), (e["target_chars"] + target).alias("target_chars"))))

    for bad in (moved(0, 1, 0), moved(0, -1, 0), moved(0, 1, -1), moved(0, 0, 1), moved(0, 0, -1), moved(-1, 0, 0), formatted.withColumn("examples", F.slice("examples", 1, F.greatest(F.size("examples") - 1, F.lit(0))))):
        with pytest.raises(Exception, match="example"):
            chat.conversation_digest(bad).collect()


# 9

def test_packing_holds_every_token_once(spark, docs, odd):
    of = encode("byte_bpe_50k.json")
    pieces = packing.token_pieces(docs.select("doc_id", "text").unionByName(odd.where("doc_id IN (1, 2)").selectExpr("-doc_id AS doc_id", "text")), queries.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(pieces).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in docs.collect():
        ids, own = [*of(r["text"]), 0], sorted(by[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own))) and all(p["length"] == 2048 for p in own[1:])
        for p in own:
            assert p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]])
        assert sum(p["length"] for p in own) == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 4


def test_packing_is_the_same_in_any_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 50, int(p), 0, int(n)) for k, (p, n) in enumerate(zip(rng.integers(0, 9, 9000), rng.integers(1, 2049, 9000)))]
    rows += [(1, 1, 0, 700)] * 3000  # repeated rows are pieces of their own
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long").coalesce(3)
    found = []
    for size in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, packing.pack(df).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and sorted(r[:4] for r in found[0]) == sorted(rows)
    # best-fit decreasing without bounds fills 0.997 of these
    counts = packing.fill(packing.pack(spark.createDataFrame(rows[:9000], df.schema))).first()
    assert counts["filled"] > 0.97 and counts["sequences"] >= counts["least"]


def test_bins_close_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.place(n) for n in (6, 7, 8, 3, 1)] == [(0, 0), (1, 0), (2, 0), (0, 6), (0, 9)]
    with pytest.raises(ValueError):
        b.place(11)


# 10

def test_language_letters_past_the_first_planes(spark):
    no_letter = ["\U0001f600\U0001f680", "\u3000\u3000", "\u3001\u3002\u300c\u300d", "\uff11\uff12\uff13", "\ufffd"]
    letters = ["\u4e2d\u6587", "\uac00\ub098", "\uff21\uff22", "\U00020000"]
    assert [language.bucket_counts(t) is None for t in no_letter + letters] == [True] * len(no_letter) + [False] * len(letters)
    mixed = language.bucket_counts("\u3000\u4e2d\u6587\u3002\U0001f600")
    assert (mixed == language.bucket_counts(" \u4e2d\u6587 ")).all()
    train = spark.createDataFrame([(k, "abc def" if k % 2 else "xyz uvw", "a" if k % 2 else "b") for k in range(200)], "doc_id long, text string, lang string")
    found = language.predict_language(spark.createDataFrame([(k, t) for k, t in enumerate(no_letter)], "doc_id long, text string"), language.fit_language_model(train)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_language_takes_every_labelled_language(spark):
    rows = [(k, f"text number {k % 520} of many", f"l{k % 520:03d}") for k in range(520 * 12)]
    model = language.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=3)
    trained = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(trained) > 500 and len(model.languages) > 500 and set(model.languages) <= trained


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    one, other = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][:2]
    rows = [(one, f"text number {k} in a", "a") for k in range(3000)] + [(other, "the same text", "b")] * 3000 + [(k, f"words {k}", "b") for k in range(100, 400)]
    seen = []
    monkeypatch.setattr(language, "train", lambda samples: seen.append(len(samples)))
    language.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert seen and 10 < seen[0] < 200


def test_language_held_out_accuracy(spark, docs, odd):
    model = language.fit_language_model(docs)
    rows = language.predict_language(docs, model).where(language.held_out()).where("lang IS NOT NULL AND text RLIKE '[A-Za-z]{3}'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    none = language.fit_language_model(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(odd, none).collect()} == {"und"}


# common

def test_no_local_folder_on_a_cluster(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})

        class conf:  # noqa: N801
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster, "x")
    assert common.unused(spark.range(1).selectExpr("id AS Kept", "id AS kept_"), "kept") == "kept__"
    assert "broadcast" in common.small(spark.range(10), 8)._jdf.queryExecution().toString() and "broadcast" not in common.small(spark.range(10), 8, limit=50)._jdf.queryExecution().toString()


def test_components(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 9), (5, 5), (None, 2)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and got[9] == got[7] == got[3] == 3 and 2 not in got and 5 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
