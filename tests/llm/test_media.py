"""Interleaved sequences and the media store, by round trip and brute force."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import media, queries


def expected(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def stored(text):
    """Digest, size and feature of the stored image, from the samples alone."""
    raw = (text or "").encode()
    x = np.frombuffer(raw + b"\xff" * ((-len(raw) % 576) or (0 if raw else 576)), np.uint8).reshape(-1, 24)
    image = media.encode_image(x.tobytes())
    cells = [np.mean([x[r, 3 * c : 3 * c + 3].mean() for r in range(len(x) * k // 8, len(x) * (k + 1) // 8)]) for k in range(8) for c in range(8)]
    bits = sum(1 << (63 - k) for k, v in enumerate(cells) if v > np.mean(cells) + 1e-9)
    return hashlib.sha256(image).hexdigest(), len(image), f"m{x.mean():.3f};s{x.std():.3f};a{bits:016x}"


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op1_media(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(docs[r.doc_id])
        assert (r.media_sha256, r.media_bytes, r.feature) == stored(docs[r.doc_id])


def test_pages_table(spark, sf_dir):
    """Every word that stands in a page's plain paragraphs is in its sequence, in order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "html").collect()
    got = {r.id: r.sequence for r in media.parse_sequences(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()}
    assert set(got) == {r.id for r in pages} and sum(bool(x) for x in got.values()) > len(pages) / 2
    for r in pages:
        text = " ".join(x.text for x in got[r.id] if x.kind == "text")
        plain = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", r.html or "")
        at = 0
        for p in re.findall(r"(?is)<p>([^<&]*)</p>", plain):
            at = text.find(" ".join(p.split()), at)
            assert at >= 0
        assert [x.position for x in got[r.id]] == list(range(len(got[r.id])))


def simple(html):
    return [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.interleave(html)]


def test_unclosed_elements_lose_nothing():
    assert simple("<figure><img src=a><figcaption>cap<p>rest</p><p>more</p>") == [("media", "a", "cap"), ("text", "rest", None), ("text", "more", None)]
    assert simple("<figure><img src=a><figcaption>cap</figure><p>more</p>") == [("media", "a", "cap"), ("text", "more", None)]
    assert simple("<figure><figcaption>Cap</figcaption><img src=x></figure>") == [("media", "x", "Cap")]
    assert simple("<figure><figcaption><p>A</p><p>B</p></figcaption><img src=x><img src=y alt=z></figure>t") == [("media", "x", "A B"), ("media", "y", "A B"), ("text", "t", None)]
    assert simple("a<template>b<p>c</p>") == [("text", "a", None), ("text", "b", None), ("text", "c", None)]
    assert simple("a<noscript><img src=x>b</noscript>c<template>d</template>") == [("text", "a", None), ("text", "c", None)]
    assert simple("<figure><figure><img src=i><figcaption>in</figcaption></figure><img src=o><figcaption>out</figcaption></figure>") == [("media", "i", "in"), ("media", "o", "out")]
    assert simple("<figure><figcaption>no media</figcaption></figure><figcaption>stray</figcaption>x</figure></template>") == [("text", "no media", None), ("text", "stray", None), ("text", "x", None)]
    assert simple("<p>a<script>b") == [("text", "a", None)]


def test_captions_of_nested_figures():
    assert simple("<figure><figure><img src=i></figure><img src=o><figcaption>out</figcaption></figure>") == [("media", "i", "out"), ("media", "o", "out")]
    assert simple("<figure><figure><img src=i><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("media", "i", "in"), ("text", "out", None)]
    assert simple("<figure><figcaption>a <figure><img src=i></figure> b</figcaption></figure>c") == [("media", "i", "a b"), ("text", "c", None)]
    assert simple("<figure><img src=a alt=x><template><figcaption>no<img src=t></figcaption></template></figure>") == [("media", "a", "x")]
    assert simple("<figure><img src=a><figcaption>1</figcaption>text<figcaption>2</figcaption></figure>") == [("media", "a", "1 2"), ("text", "text", None)]


def test_long_broken_pages_are_linear():
    """Each takes minutes if every open tag is looked for to the end again, or items are moved about."""
    n = 100_000
    began = time.monotonic()
    for html in ("<a " * n, "</a " * n, "<!-- " * n, "<![CDATA[" * n, "<? " * n, "<a x=\"" * n, "<" * n, "<figure><figcaption>x" * n, "<figure><img src=a>" * n + "</figure>" * n, "<figcaption>x" * n, "<template>x" * n):
        media.interleave(html)
    assert time.monotonic() - began < 60
    assert simple("a < b <i") == [("text", "a < b <i", None)]
    assert simple("<p>x</p>" + "<b " + "y" * media.TAG + "> z") == [("text", "x", None), ("text", "<b " + "y" * media.TAG + "> z", None)]
    deep = simple("<figure><img src=a>" * 2000 + "<figcaption>last</figcaption>" + "</figure>" * 2000)
    assert deep[-1] == ("media", "a", "last") and deep[0] == ("media", "a", None) and len(deep) == 2000


def test_hot_digests_are_not_shuffled(spark):
    pages = spark.createDataFrame([(k, f"<img src={'hot' if k % 3 else 'gone' if k % 2 else k}>") for k in range(300)], "id long, html string")
    objects = spark.createDataFrame([("hot", 1), *((str(k), k) for k in range(300))], "media_digest string, n int")
    got = {r.id: (r.ref, r.n) for r in media.resolve(media.parse_sequences(pages), objects).collect()}
    assert got == {k: ("hot", 1) if k % 3 else ("gone", None) if k % 2 else (str(k), k) for k in range(300)}


def test_cases(spark):
    texts = [None, "", "x" * 576, "é" * 5000, "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in media.documents_as_media(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(t) and r.position is not None
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    assert media.documents_as_media(df.limit(0)).count() == 0


def test_image_is_lossless():
    data = bytes(range(256)) * 9
    samples, width = media.decode_image(media.encode_image(data))
    assert samples.tobytes() == data and width == 24


def test_interleaving_keeps_order_and_captions():
    page = "<h1>A &amp; B</h1><p>one <script>no()</script>two<figure><img src='a.png' alt='x'><img src='b.png'><figcaption> The  two </figcaption></figure>three"
    got = media.interleave(page)
    assert [(x["kind"], x["text"] or x["ref"]) for x in got] == [("text", "A & B"), ("text", "one two"), ("media", "a.png"), ("media", "b.png"), ("text", "three")]
    assert [x["position"] for x in got] == list(range(5)) and got[2]["caption"] == got[3]["caption"] == "The two"
    assert media.interleave(None) == media.interleave("") == []


def test_unresolved_reference_keeps_its_place(spark):
    pages = spark.createDataFrame([(1, "<p>t<img src='gone' alt='c'>")], "id long, html string")
    objects = spark.createDataFrame([], "media_digest string, n int")
    r = media.resolve(media.parse_sequences(pages), objects).first()
    assert (r.ref, r.position, r.caption, r.n) == ("gone", 1, "c", None)
