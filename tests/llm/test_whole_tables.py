"""Token files, stored media and toxicity over all documents of a table, against the libraries and plain Python."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyrail.llm import media, repair, toxicity
from tallyrail.llm.training import bucket

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_token_files_of_all_documents(docs, texts):
    """Starts, counts and digests read back from the files are those of the library's ids in order of doc_id."""
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    got, start = {r["doc_id"]: tuple(r)[1:] for r in repair.token_files(docs).collect()}, 0
    assert set(got) == set(texts)
    for doc_id in sorted(texts):
        ids = [*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stored_media_of_all_documents(docs, texts):
    got = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        stored = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["caption"]) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{len(raw)} bytes")
        mean = sum(payload) / len(payload)
        parts = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(parts["rows"]) == len(payload) // 192 and abs(float(parts["mean"]) - mean) < 1e-3
        entropy = -sum(p * math.log2(p) for p in (payload.count(b) / len(payload) for b in set(payload)))
        assert abs(float(parts["entropy"]) - entropy) < 1e-3


def test_toxicity_of_all_documents(spark, docs, texts):
    """Every text's score again: features added up by hand, a plain pass over the chain, the logistic fit of its marginals."""
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.tag(docs, model).collect()}
    assert set(got) == set(texts)
    known: dict[str, float] = {}
    (s00, s01), (s10, s11) = model.trans.tolist()
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for doc_id, text in texts.items():
        words = (text or "").split()
        odds = [known.setdefault(w, model.bias + sum(float(model.weights[bucket(n, toxicity.BITS)]) for n in toxicity.names(w))) if w not in known else known[w] for w in words]
        odds = [min(30.0, max(-30.0, x)) for x in odds]
        ahead = []
        for x in odds:
            a, b = ahead[-1] if ahead else (0.0, 0.0)
            ahead.append((add(a + s00, b + s10), add(a + s01, b + s11) + x) if ahead else (0.0, x))
        p, behind = [0.0] * len(odds), (0.0, 0.0)
        for t in range(len(odds) - 1, -1, -1):
            z0, z1 = ahead[t][0] + behind[0], ahead[t][1] + behind[1]
            p[t] = 1 / (1 + math.exp(min(700.0, z0 - z1)))
            x = odds[t] + behind[1]
            behind = (add(s00 + behind[0], s01 + x), add(s10 + behind[0], s11 + x))
        top = min(max(max(p, default=0.0), 1e-6), 1 - 1e-6)
        z = float(model.fit @ np.array([1.0, math.log(top / (1 - top)), math.log1p(sum(x for x in p if x > 0.5))]))
        assert abs(got[doc_id]["score"] - 1 / (1 + math.exp(-z))) < 1e-4
        marked = sum(x > 0.5 for x in p)
        assert (marked == 0) == (len(got[doc_id]["spans"]) == 0) and sum(len(text[s["start"] : s["end"]].split()) for s in got[doc_id]["spans"]) == marked
