"""The classifiers' scores against plain loops from the trained weights, and each stage of the pipeline against a plain version of its rule."""

import math
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash

from tests.llm import brute
from tidewake.llm import quality, toxicity
from tidewake.llm.common import written
from tidewake.llm.queries import SURROGATE_KEY


def sigmoid(z):
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def hashed(part, buckets):
    return xxhash.xxh3_64_intdigest(part) % buckets


def plain_toxicity(model, text):
    """A text's words become vectors, each filter runs over all places (words beyond the end are nothing), its largest value counts."""
    lower = text.lower().encode()
    vectors = []
    for word in re.findall(rb"[a-z\x80-\xff]+", lower):
        parts = [word] + [b"\0" + word[:k] for k in (5, 6, 7, 8, 9) if len(word) > k]
        vectors.append(sum(model.table[hashed(p, 1 << 17)].astype(float) for p in parts) / math.sqrt(len(parts)))
    pooled = []
    for f in model.filters:
        many, width, _ = f.shape
        for c in range(many):
            places = [sum(float(f[c, k] @ vectors[i + k]) for k in range(width) if i + k < len(vectors)) for i in range(max(1, len(vectors) - width + 1))]
            pooled.append(max(places) if vectors else 0.0)
    z = float(model.out0) + sum(max(0.0, p + float(b)) * float(o) for p, b, o in zip(pooled, model.bias, model.out, strict=True))
    return sigmoid(model.scale * z + model.shift)


def plain_view(view, sparse, dense):
    z = view.bias + sum(float(view.hashed[k]) * w for k, w in sparse)
    for d, mean, spread, weight in zip(dense, view.mean, view.spread, view.dense, strict=True):
        z += min(8.0, max(-8.0, (d - mean) / spread)) * weight
    return view.a * z + view.b


def plain_quality(model, text, lang, source, n_chars):
    raw = text.encode()
    ws = raw.split()
    sparse, dense = [], [0.0] * 10
    if ws:
        n, distinct = len(ws), set(ws)
        sparse = [(hashed(w, 1 << 16), 0.2 / math.sqrt(len(distinct))) for w in distinct]
        kind = lambda b: "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b)
        for w in ws:
            s = "".join(map(kind, w))
            end = "." if s[-1].isalnum() else s[-2:]
            sparse.append((hashed(b"\0e" + end.encode(), 1 << 16), 1 / n))
            sparse.append((hashed(b"\0s" + (b"A" if s[:2].isupper() else b"a"), 1 << 16), 1 / n))
        share = lambda of: sum(map(of, raw)) / len(raw)
        symbols = share(lambda b: chr(b) in "#$%&*+/<=>@[\\]^_`{|}~")
        dense = [symbols, share(lambda b: kind(b) == "A"), share(lambda b: kind(b) == "a"), share(lambda b: kind(b) == "0"), len(distinct) / n, len(distinct) / n**0.8,
            raw.count(b"!") / n, raw.count(b" | ") / n, raw.count(b".") / n, (len(raw) - n) / n / 10]
    lines = text.count("\n") + 1
    length, line = math.log1p(n_chars), math.log1p(len(raw) / lines)
    names = [f"lang={lang}", f"source={source}", f"length={int(2 * length)}", f"line={int(2 * line)}", f"lines={int(2 * math.log1p(lines))}"]
    record = [(hashed(x.encode(), 1 << 10), 0.3) for x in names]
    a = plain_view(model.content, sparse, dense)
    b = plain_view(model.meta, record, [length / 10, line / 10, math.log1p(lines) / 10] + [0.0] * 7)
    w = model.weights
    return sigmoid(w[0] * a + w[1] * b + w[2]), sigmoid(a), sigmoid(b)


@pytest.fixture(scope="module")
def trained(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    return docs, docs.toPandas(), quality.train(docs, labels), toxicity.train(docs, labels)


def test_quality_scores_plainly(trained):
    docs, rows, model, _ = trained
    assert model.constant is None
    got = quality.score(docs, model).toPandas().set_index("doc_id")
    for r in rows.itertuples():
        want, own = plain_quality(model, r.text or "", r.lang, r.source, r.n_chars), got.loc[r.doc_id]
        assert np.allclose(want, own[["score", "content_score", "metadata_score"]].astype(float), atol=1e-4)
        assert own["rejected"] == (want[0] < 0.4) or abs(want[0] - 0.4) < 1e-4


def test_toxicity_scores_plainly(trained):
    docs, rows, _, model = trained
    assert model.constant is None
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")
    for r in rows.itertuples():
        want, own = plain_toxicity(model, r.text or ""), got.loc[r.doc_id]
        assert abs(want - own["score"]) < 1e-3
        assert own["predicted"] == (own["score"] >= 0.7) and own["held_out"] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert own["flagged"] == (own["score"] >= model.thresholds.get(r.lang or "", 0.7))


def plain_groups(rows):
    """The least doc_id of each document's group: shared five-word shingles at 80 % of all, by an index of shingles."""
    sets, holders, root = {}, defaultdict(list), {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
        root[i] = i
        for s in sets[i]:
            holders[s].append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for pair in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        a, b = pair
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_each_stage_against_its_rule(spark, data, trained, monkeypatch):
    docs, _, good, toxic = trained
    monkeypatch.setattr(quality, "train", lambda *a: good)
    monkeypatch.setattr(toxicity, "train", lambda *a: toxic)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.toPandas(), written(stage(spark, docs, data), f"plain-{name}")
        after = docs.toPandas()
        if name == "quality":
            score = {r.doc_id: plain_quality(good, r.text or "", r.lang, r.source, r.n_chars)[0] for r in before.itertuples()}
            assert set(after["doc_id"]) ^ {i for i, s in score.items() if s >= 0.4} <= {i for i, s in score.items() if abs(s - 0.4) < 1e-4}
        elif name == "toxicity":
            over = {r.doc_id: plain_toxicity(toxic, r.text or "") - toxic.thresholds.get(r.lang or "", 0.7) for r in before.itertuples()}
            assert set(after["doc_id"]) ^ {i for i, s in over.items() if s < 0} <= {i for i, s in over.items() if abs(s) < 1e-3}
        elif name == "near_duplicates":
            groups = plain_groups(list(zip(before["doc_id"], before["text"], strict=True)))
            assert sorted(after["doc_id"]) == sorted(i for i, g in groups.items() if i == g) and len(after) < len(before)
        elif name == "privacy":
            want = dict(zip(before["doc_id"], (r[0] for r in brute.replaced(before["text"].tolist(), SURROGATE_KEY)), strict=True))
            assert dict(zip(after["doc_id"], after["text"], strict=True)) == want and list(want.values()) != before["text"].tolist()
        else:
            encoder, pieces, filled = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), defaultdict(list), defaultdict(list)
            for r in after.itertuples():
                pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
                filled[r.sequence_id].append((r.offset, r.length))
            for r in before.itertuples():
                ids, at = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 1], 0
                for start, length, crc in sorted(pieces.pop(r.doc_id)):
                    assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                    at += length
                assert at == len(ids)
            assert not pieces
            for own in filled.values():
                own.sort()
                assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
