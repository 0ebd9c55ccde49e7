"""Ids of other types, column names that clash in another case, foreign and damaged archives, long conversations."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricord.llm import chat, common, html_text, jaccard, language, packing, queries, toxicity, warc


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_toxicity_of_ids_of_any_type(spark, sf, kind):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for given in (labels, labels.withColumn("doc_id", F.col("doc_id").cast(kind))):
        chain = toxicity.fit_toxicity(docs, given)
        assert chain.threshold < 1 and len(chain.models[-1].chosen) > 0
        found = toxicity.predict_toxicity(docs, chain)
        assert found.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind) and found.where("is_toxic").count() > 0


def test_columns_named_as_the_result_in_another_case(spark):
    df = spark.createDataFrame([(1, "some words here", "x", "en", "<p>some words here</p>")], "doc_id long, text string, other string, lang string, html string")
    pages = html_text.extract_text(df.select("doc_id", "html", F.lit(1).alias("TEXT")))
    assert sorted(pages.columns) == ["doc_id", "text"] and pages.select("text").first()[0] == "some words here"
    model = language.fit_language_model(df)
    found = language.predict_language(df.select("doc_id", "text", F.lit(1).alias("Score"), F.lit(2).alias("LANG_PRED")), model)
    assert found.select("score", "lang_pred", "doc_id").count() == 1 and len(found.columns) == 4
    toxic = toxicity.predict_toxicity(df.select("doc_id", "text", F.lit(1).alias("Is_Toxic"), F.lit(2).alias("P_TOXIC")), toxicity.no_chain(tuple(toxicity.CATEGORIES)))
    assert not toxic.select("is_toxic").first()[0] and toxic.select("p_toxic").count() == 1
    pieces = packing.token_pieces(df, queries.tokenizer_path("byte_bpe_50k.json")).withColumn("Offset", F.lit(7)).withColumn("Sequence_Id", F.lit(7))
    assert packing.pack(pieces).select("offset", "sequence_id").first() == (0, 0) or packing.pack(pieces).select("offset").first()[0] == 0


# archives

def archive(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return spark.createDataFrame([(name,)], "file string")


def record(kind, record_id, block, *more):
    return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "2024-01-01T00:00:00Z"), *more], block)


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
TYPE = ("Content-Type", "application/http; msgtype=response")


def test_records_of_other_makers(spark, tmp_path):
    page = b"<p>hello</p>"
    data = record("warcinfo", "<urn:uuid:1>", b"software: x\r\n", ("Content-Type", "application/warc-fields"))
    data += record("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", ("Content-Type", "application/http; msgtype=request"))
    data += record("response", "<urn:uuid:3>", HTTP + page, TYPE, ("WARC-Target-URI", "http://a"))
    data += record("response", "<urn:uuid:4>", HTTP + page, TYPE, ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(page).hexdigest()))
    data += record("response", "<urn:uuid:5>", HTTP + page, TYPE, ("WARC-Payload-Digest", "blake9:whatever"))
    data += record("metadata", "<urn:uuid:6>", b"x: y") + record("resource", "<urn:page:7>", page, ("WARC-Payload-Digest", "sha1:" + warc.sha1_base32(page)))
    data += record("revisit", "<urn:uuid:8>", HTTP, TYPE, ("WARC-Refers-To", "<urn:uuid:3>"))
    got = warc.read_warc(archive(spark, tmp_path, "a.warc.gz", data), f"file://{tmp_path}").orderBy("record_id").collect()
    assert [(r["record_id"], r["page_id"], r["refers_to"], r["record_type"]) for r in got] == [("<urn:page:7>", 7, None, "resource"), *[(f"<urn:uuid:{k}>", None, None, "response") for k in (3, 4, 5)], ("<urn:uuid:8>", None, None, "revisit")]
    assert [r["payload_digest"] for r in got] == [warc.sha1_base32(page), None, "sha256:" + hashlib.sha256(page).hexdigest(), "blake9:whatever", None]
    assert [r["payload"] for r in got] == [page] * 4 + [b""] and got[1]["url"] == "http://a"


def member(text):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


GOOD = record("response", "<urn:page:1>", HTTP + b"<p>x</p>", TYPE)


@pytest.mark.parametrize("damaged, message", [
    (GOOD + GOOD[:-1], "ends inside"), (GOOD + GOOD[:30], "ends inside"), (GOOD[:-12], "ends inside"),
    (member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), "shorter"),
    (member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"), "longer"),
    (member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"), "without a content length"),
    (member(b"WARC/1.1\r\nContent-Length: 3\r\n"), "without an end"), (member(b"HTTP/1.1 200 OK\r\n\r\n"), "not a WARC record"),
    (record("response", "<urn:page:1>", HTTP + b"x", TYPE, ("WARC-Payload-Digest", "sha1:" + warc.sha1_base32(b"y"))), "doesn't match"),
    (record("response", "<urn:page:1>", HTTP + b"x", TYPE, ("WARC-Block-Digest", "md5:" + hashlib.md5(b"y").hexdigest())), "doesn't match"),
])
def test_damaged_archives_are_refused(spark, tmp_path, damaged, message):
    with pytest.raises(Exception, match=message):
        warc.read_warc(archive(spark, tmp_path, "bad.warc.gz", damaged), f"file://{tmp_path}").collect()


# conversations and texts

def test_chat_digest_of_many_turns(spark):
    n = 6400
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" é<")), F.lit(100)).alias("text"))
    chat.conversation_digest(chat.format_conversations(turns.limit(4))).collect()
    began = time.time()
    row = chat.conversation_digest(chat.format_conversations(turns)).first()
    assert time.time() - began < 20
    loss = "".join(f"{k} é<" * 100 for k in range(1, n, 2))
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17])
def test_language_blocks_count_every_ngram_once(monkeypatch, size):
    texts = ["Hello, wörld! 12 a", "  ...  leading", "trailing ... 99  ", "a", "ab c", "..", "", "x1y2z3", "éé  --  ÀÀ b"]
    whole = [language.bucket_counts(t) for t in texts]
    monkeypatch.setattr(language, "BLOCK", size)
    for t, want in zip(texts, whole, strict=True):
        got = language.bucket_counts(t)
        assert (got is None) == (want is None) and (want is None or np.array_equal(got, want)), t
    assert whole[5] is None and whole[6] is None


def test_language_ngrams_against_plain_ones():
    """The counts of a text are those of its n-grams, one after another in plain Python."""
    text = "The cät, the DOG 42!"
    stream = " "
    for c in text.lower():
        if c.isalpha() or stream[-1] != " " or stream == " ":
            stream += c if c.isalpha() else " "
    stream += " "
    want = np.zeros(language.BUCKETS, dtype=np.int64)
    for n in range(1, language.NGRAMS + 1):
        for i in range(len(stream) - n + 1):
            mixed = 0
            for c in stream[i : i + n]:
                mixed = (mixed * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            h = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            want[h >> 64 - language.BUCKETS.bit_length() + 1] += 1
    assert np.array_equal(language.bucket_counts(text), want)


def test_common_keeps_no_helpers_of_its_own():
    from tricord.plans import storage

    assert common.shared_dir is storage.shared_dir and common.small is storage.small


def test_shingles_are_counted_alike_in_ten_thousand_ranges(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = np.array([f"w{k}" for k in range(40)])
    texts = [" ".join(words[rng.integers(0, 12 if i % 3 else 40, rng.integers(3, 60))]) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    keys, counts = jaccard.frequent_shingles(docs, often=2)
    own = [np.unique(jaccard._key40(jaccard.shingle_set(t))) for t in texts]
    want, n = np.unique(np.concatenate(own), return_counts=True)
    assert np.array_equal(keys, want[n >= 2]) and np.array_equal(counts, n[n >= 2])
    size = sum(len(t) for t in texts)
    monkeypatch.setattr(jaccard, "PER_RANGE", max(1, size // jaccard.TEXT_BYTES // 10_000))
    began = time.time()
    again = jaccard.frequent_shingles(docs, often=2)
    assert np.array_equal(again[0], keys) and np.array_equal(again[1], counts) and time.time() - began < 60
