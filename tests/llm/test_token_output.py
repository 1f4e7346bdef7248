import io
import random
import zlib

import numpy as np
import pytest

from quiverlake.llm import token_output as K
from quiverlake.llm.common import public_vocabulary

from . import cases

PATH = public_vocabulary("byte_bpe_50k.json")
TEXTS = ["", "  ", "a\n", " a", "x  y", " \n\n foo  bar's\t'll it'll ", "ends  ", "日本 語　", "1 23  456\n\n\n7", "a. b, c!d", "naïve café—déjà", "it's 'store' we'll", "\x1c odd\xa0space"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_tokenizers_ids(name):
    e = K.Encoder(public_vocabulary(name), cache=20)
    for _ in range(2):
        ids, n = e.encode(TEXTS)
        at = 0
        for t, k in zip(TEXTS, n):
            assert ids[at : at + k].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [0]
            at += k


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_and_files_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 7 else 50_257, n).astype("<u4")
    assert (K.from_planes(K.to_planes(ids, mode), n, mode) == ids).all()
    out = io.BytesIO()
    w = K.ShardWriter(out, block=64, mode=mode, doc_block=3)
    r = random.Random(n)
    cuts = sorted(r.randrange(n + 1) for _ in range(3))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
        w.add([i or None], [b - a], ids[a:b])
    w.close()
    reader = K.ShardReader(out, len(out.getvalue()))
    assert (reader.ids(0, n) == ids).all() and list(reader.documents()) == [(i or None, b - a) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, n]))]
    for a, b in ((0, n // 2), (n // 3, n), (n, n)):
        assert (reader.ids(a, b) == ids[a:b]).all()


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 7)
    e = K.Encoder(PATH)
    for t in [*TEXTS, "  ".join(TEXTS), "x" * 50, " " * 30 + "a" + "\n" * 20, cases.words(60, 4)]:
        assert np.concatenate([*e.slices(t), np.zeros(0, "<u4")]).tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_reads_a_task_a_shard(spark):
    shards = K.write_tokens(cases.docs(spark, [cases.words(30, i) for i in range(40)]), PATH)
    n = shards.count()
    assert n > 1 and K.read_tokens(shards, K.digest, K.DIGEST).rdd.getNumPartitions() == n


def test_digest_equals_brute_force(spark):
    t = TEXTS + [cases.words(50, i) for i in range(30)] + [None]
    got = K.token_output(cases.docs(spark, t), PATH, block=100).orderBy("doc_id").collect()
    tok, start = K.tokenizer_of(PATH)[0], 0
    for r, x in zip(got, t):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 0]
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_awkward_rows(spark):
    got = K.token_output(cases.frame(spark), PATH).collect()
    assert len(got) == len(cases.awkward())
    assert sorted(r.start for r in got)[0] == 0 and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {1}
    assert not K.token_output(cases.frame(spark, []), PATH).collect()
