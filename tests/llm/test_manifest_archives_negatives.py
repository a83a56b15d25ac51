"""Manifests, archives and hard negatives against brute force, on given tables and on small awkward ones."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formbook.llm import merkle, negatives, queries, warc
from formbook.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _group string, _at long, _steps string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids with two texts, clashing column names, more leaves than one subtree holds."""
    rows = [
        (1, "Ab", "en", "a", 9, "x", 1, "y"), (2, "Ab", None, "b", 9, None, 2, "y"), (2, "Ab", None, "b", 9, None, 2, "y"), (3, None, "en", None, None, "x", None, None), (3, "Z", "en", None, 1, "x", 1, "y"),
        (4, "", "", "a", 0, "x", 0, "y"), (None, "Null", "en", None, 1, "x", 1, "y"), (8, "X" * 300_000, "en", "a", 1, "x", 1, "y"), (-5, "é", "en", "a", 1, "x", 1, "y"),
    ]
    rows += [(i, f"Text {i}", "de", "s", i, "x", 0, "y") for i in range(100, 700)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes):
    """(root, per node the list of (before, after))."""
    steps = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, kept = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j in range(len(run)):
                for i in held[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(h(*run))
            kept.append([i for g in held[a : a + 8] for i in g])
        nodes, held = ups, kept
    return nodes[0], steps


def manifest_by_hand(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        mine = sorted(langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[lang] = mine, *tree([leaf_of(r, r["text"]) for r in mine])
    root, tops = tree([trees[lang][1] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        mine, subroot, steps = trees[lang]
        for r, proof in zip(mine, steps, strict=True):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            at = leaf_of(r, text)
            for before, after in proof + top:
                at = h(before, at, after)
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root, h(*[b + a for b, a in proof + top]), at, at == root))
    return out


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def op11(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return [tuple(r) for r in queries.op11(spark, "").collect()]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_with_proofs(spark, odd, none, monkeypatch, height):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, height=height, **k))
    got = op11(spark, odd, monkeypatch)
    assert same(got, manifest_by_hand(odd.collect()))
    assert {r[-1] for r in got} == {True, False}
    if height == 2:
        assert op11(spark, none, monkeypatch) == []
        one = odd.where("doc_id = 1")
        assert same(op11(spark, one, monkeypatch), manifest_by_hand(one.collect()))


def test_manifest_of_the_given_documents(spark, data, monkeypatch):
    docs = table(spark, data, "documents")
    assert same(op11(spark, docs, monkeypatch), manifest_by_hand(docs.collect()))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4096), st.integers(0, 3))
def test_sweep_of_a_subtree(n, block):
    size = merkle.FAN**merkle.HEIGHT
    digests = [h(str(i)) for i in range(n)]
    total = n if not block else block * size + n
    levels = merkle.sweep(digests, total, block * size)
    nodes, left = digests, total
    for level in levels[1:]:
        nodes, left = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], -(-left // 8)
        assert level == nodes
    assert len(levels[-1]) == 1


PAGES = "page_id long, url string, html string, payload string, _first long"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "é" * 700, "o" * 1000
    rows = [
        (1, "http://a/b", big, "p", 1), (2, "http://a/c\r\nWARC-Type: resource", big, "p", 1), (3, None, big, "p", 1), (3, "u", big, "p", 1), (4, "u", other, None, None), (5, "u", "small", None, 1), (6, "u", "small", None, 1),
        (7, "u", None, "p", 1), (8, "u", "", "p", 1), (None, "u", big, "p", 1), (None, "u", "q" * 2000, "p", 1), (None, "u", "q" * 2000, "p", 1), (9, "u", "long " * 200_000, "p", 1), (-4, "u", other, "p", 1),
        (10, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "p", 1), (11, "u", "\r\n\r\n", "p", 1),
    ]
    return spark.createDataFrame(rows, PAGES)


def archive_by_hand(rows):
    first = {}
    for r in rows:
        if len((r["html"] or "").encode()) >= 1000 and r["page_id"] is not None:
            first[r["html"]] = max(r["page_id"], first.get(r["html"], r["page_id"]))
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = first.get(r["html"]) if r["html"] else None
        again = to is not None and to != r["page_id"]
        out.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return out


def test_pages_survive_archives(spark, pages, data, monkeypatch):
    for given_pages in (pages, pages.limit(0), table(spark, data, "pages")):
        monkeypatch.setattr(queries, "table", lambda *_, p=given_pages: p)
        assert same([tuple(r) for r in queries.op12(spark, "").collect()], archive_by_hand(given_pages.collect()))


def test_reader_pushes_predicates_and_skips_payloads(spark, pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write(warc.records(pages), folder, roll=2000)
    warc.write(warc.records(pages.limit(1)), folder)
    (tmp_path / "archive" / "part-lost.warc.gz").write_bytes(b"what a lost task left")
    everything = warc.read(spark, folder)
    files = everything.where("record_type = 'warcinfo'").select("file").distinct().count()
    assert files > 3  # new files at the limit
    revisits = warc.read(spark, folder, ["record_type", "record_id", "headers"]).where("record_type = 'revisit' AND record_id LIKE '<urn:page:%'")
    assert "+- Filter" not in revisits._jdf.queryExecution().executedPlan().toString()  # all of it is pushed
    assert sorted(r["record_id"] for r in revisits.collect()) == ["<urn:page:-4>", "<urn:page:1>", "<urn:page:2>", "<urn:page:>"]
    bodies = {r["record_id"]: bytes(r["payload"]) for r in everything.where("record_type = 'response' AND content_length > 0").collect()}
    assert bodies["<urn:page:9>"] == b"long " * 200_000 and bodies["<urn:page:7>"] == b""
    assert everything.where("record_type = 'resource'").count() == 0  # a header cannot be smuggled in
    small = warc.read(spark, folder, ["record_id", "target_uri"], split=1).where("target_uri IS NULL AND record_id > '<urn:page:2>' AND record_id < '<urn:q'")
    assert [r["record_id"] for r in small.collect()] == ["<urn:page:3>"]
    with pytest.raises(Exception, match="appended"):
        warc.records(pages).write.format("warc").mode("overwrite").save(folder)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_archives_of_other_makers(tmp_path):
    noise = np.random.default_rng(3).integers(0, 256, 600_000, dtype=np.uint8).tobytes()
    rows = [
        {"record_type": "response", "record_id": "<a>", "payload": noise, "payload_digest": hashlib.sha1(noise).hexdigest(), "target_uri": "u"},
        {"record_type": "resource", "record_id": "<b>", "payload": b"text", "content_type": "text/plain"}, {"record_type": "response", "record_id": "<c>", "payload": b"", "target_uri": "u"},
    ]
    plain = [warc.record(r) for r in rows]
    for data, seeks in ((b"".join(plain), True), (b"".join(gzip.compress(p) for p in plain), False), (gzip.compress(b"".join(plain)), False), (b"".join(warc.member(p) for p in plain), True)):
        found = list(warc.scan(io.BytesIO(data), "f", ["record_id", "payload"], []))
        assert [(r["record_id"], r["payload"]) for r in found] == [("<a>", noise), ("<b>", b"text"), ("<c>", b"")]
        assert found[0]["payload_digest"] == hashlib.sha1(noise).hexdigest()
        raw = Counted(data)
        assert [r["record_id"] for r in warc.scan(raw, "f", ["record_id", "payload"], [("EqualTo", "record_type", "resource")])] == ["<b>"]
        assert (raw.taken < 300_000) == seeks  # the payload that is not wanted is not read where that can be told
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(warc.member(plain[0])[:-3000]), "f", ["payload"], []))
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(b"something else\r\n\r\n"), "f", ["payload"], []))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.sampled_from([1, 300, 2**20, 2**27, 2**33, 2**45]))
def test_scores_in_residues_are_exact(seed, width, most):
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(-most, most + 1, (n, width)).astype(float) for n in (5, 7))
    want = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
    assert negatives.all_scores(a, b).tolist() == want


def negatives_by_hand(rows, scale=256):
    once = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        z = (label, [int(np.floor(scale * x)) for x in v])
        once[i] = min(once.get(i, z), z)
    out = []
    for a, (label, v) in once.items():
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), b, other) for b, (other, w) in once.items() if b != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return out


@pytest.mark.parametrize("block", [7, 16384])
def test_hard_negatives(spark, data, block):
    vectors = table(spark, data, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    assert same([tuple(r) for r in negatives.mine(vectors, F.col("vec_id") % 50 == 0, block=block).collect()], negatives_by_hand(rows))


def test_hard_negatives_of_awkward_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-2, 4, 3) / 4], int(draw.integers(0, 3))) for i in range(0, 120)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (250, [1.0, None, 1.0], 1), (300, [float("nan"), 1.0, 1.0], 1), (350, [1.0, float("inf"), 0.0], 1), (400, [1.0, 1.0, 1.0], None)]
    rows += [(450, [], 1), (451, [], 1), (452, [], 2), (500, [1.0, 2.0], 1), (501, [2.0, 1.0], 1), (502, [1.0, 1.5], 0), (50, [0.5, 0.5, 0.5], 2), (50, [0.5, 0.5, 0.5], 2), (0, [1.0, 1.0, 0.0], 0), (-50, [1.0, 1.0, 1.0], 2)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, v string")
    got = [tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 50 == 0, block=50).collect()]
    want = negatives_by_hand(rows)
    assert same(got, want) and any(r[4] == 0 for r in want)
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    huge = spark.createDataFrame([(50, [1e300, 0.0], 1), (1, [1e300, 0.0], 1), (2, [1.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(huge, F.col("vec_id") % 50 == 0).collect() == []
