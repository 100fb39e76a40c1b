import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing


def test_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        rows, room = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if fits:
                r, k = min(fits)
                # any of the rows with the least room will do: the count of rows is the same
                rows[k].append(i)
                room[k] -= lengths[i]
            else:
                rows.append([i])
                room.append(64 - lengths[i])
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= 64 for r in got)
        assert sorted(64 - sum(lengths[i] for i in r) for r in got) == sorted(room)


def test_lossless(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = sorted(((r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, packing.SEPARATOR]) for r in docs.collect()), key=repr)
    packed = packing.pack(docs.coalesce(1), capacity=512).collect()
    parts = {}
    for r in packed:
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert len(ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.resets == r.cu_seqlens[:-1] and ids[r.n_tokens :] == [packing.SEPARATOR] * (512 - r.n_tokens)
        pos = packing.position_ids(r.cu_seqlens, 512)
        assert all(pos[s] == 0 for s in r.resets) and pos.max() < 512
        for d, p, s, e in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(d, []).append((p, ids[s:e]))
    assert set(parts) == {d for d, _ in want}
    for d, ids in want:
        if sum(x == d for x, _ in want) == 1:
            assert [i for _, x in sorted(parts[d]) for i in x] == ids
    assert sum(len(x) for v in parts.values() for _, x in v) == sum(len(x) for _, x in want)


def test_segments(spark, sf, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {}
    for r in packing.op6_packing(spark, sf).collect():
        got[r.doc_id, r.part] = r.n_tokens, r.ids_sha256
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, packing.SEPARATOR]
        for p, i in enumerate(range(0, len(ids), packing.CAPACITY)):
            x = ids[i : i + packing.CAPACITY]
            assert got.pop((r.doc_id, p)) == (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest())
    assert not got
    assert packing.segments(packing.pack(none)).collect() == []


def test_long_texts_are_cut_where_nothing_changes(monkeypatch):
    with open(public_tokenizers.path(packing.BYTE_BPE), "rb") as f:
        e = packing._encoding(f.read())
    text = "One line, of words\nAnother  one \n\n  and\nMore é " * 60
    whole = packing.token_ids(e, text).tolist()
    monkeypatch.setattr(packing, "CALL_CHARS", 37)
    assert packing.token_ids(e, text).tolist() == whole
