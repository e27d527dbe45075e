import random
from pathlib import Path

import numpy as np
import pytest

FOLDER = "/opt/tokenizers"
if not Path(FOLDER, "byte_bpe_50k.json").exists():
    pytest.skip("no vocabulary files here", allow_module_level=True)

from caseloom.llm import bpe, containers, pieces  # noqa: E402

MODEL = bpe.load(f"{FOLDER}/byte_bpe_50k.json")


def _texts():
    rng = random.Random(3)
    odd = ["", " ", "\n\n  \t x", "a" * 5_000, "<|endoftext|> x", "it's I'll 'S", "½ ² 12345", "\U0001f600 é é", "\r\n\r\n", "xyz" * 3_000, " lead", "trail "]
    return odd + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x500), rng.randrange(0x4E00, 0x9000), 32, 10])) for _ in range(rng.randrange(1, 300))) for _ in range(200)]


def test_ids_equal_the_public_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = _texts()
    ids, at = MODEL.encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert MODEL.sizes([None, *texts]).tolist() == [0, *map(len, want)]


def test_ids_do_not_depend_on_the_word_table(monkeypatch):
    want = MODEL.encode(_texts())[0].tolist()
    monkeypatch.setattr(bpe, "WORDS", 5)
    fresh = bpe.ByteBpe(f"{FOLDER}/byte_bpe_50k.json")
    assert [x for t in _texts() for x in fresh.encode([t])[0].tolist()] == want


def test_encoded_table(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (1, "a b", "z")], "k long, text string, ids string")
    got = [(r["id"], r["ids"]) for r in bpe.encode_texts(df, "k", "text").orderBy("id").collect()]
    assert len(got) == 4 and got[0] == got[1] and got[2] == (2, []) and got[3] == (3, [])
    assert bpe.encode_texts(df.limit(0), "k", "text").count() == 0
    assert [r["n_tokens"] for r in bpe.token_counts(df, "k", "text").orderBy("id").collect()] == [2, 2, 0, 0]


@pytest.mark.parametrize("capacity,top", [(100, 100), (2048, 3000), (50, 500)])
def test_containers(spark, capacity, top):
    rng = random.Random(capacity)
    sizes = {i: rng.choice([rng.randrange(1, top), rng.randrange(1, max(2, capacity // 8)), capacity, 0]) for i in range(1500)}
    df = spark.createDataFrame([(i, n, 0) for i, n in sizes.items()] + [(None, 5, 0), (0, sizes[0], 0)], "id long, n long, size int")
    rows = containers.pack(df, "id", "n", capacity).collect()
    load, parts = {}, {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
        parts.setdefault(r["id"], []).append((r["piece"], r["size"]))
    assert max(load.values()) <= capacity and set(parts) == set(sizes)
    assert all(sum(s for _, s in p) == sizes[i] and (len(p) == 1 or sizes[i] > capacity) for i, p in parts.items())
    total = sum(sizes.values())
    assert len([c for c, n in load.items() if n]) <= 1.03 * total / capacity + 3


def test_container_edges(spark):
    empty = spark.createDataFrame([], "id long, n long")
    assert containers.pack(empty, "id", "n", 10).count() == 0
    zeros = spark.createDataFrame([(1, 0), (2, None)], "id long, n long")
    assert {r["size"] for r in containers.pack(zeros, "id", "n", 10).collect()} == {0}
    same = spark.createDataFrame([(i, 7) for i in range(50)], "id long, n long")
    assert containers.pack(same, "id", "n", 10).select("container").distinct().count() == 50


def test_best_fit_and_plan():
    assert containers.best_fit([(5, "a"), (3, "b")], [3, 3, 2], 10) == [1, 0, 0]
    plan = containers.plan_configs(np.array([30, 70]), np.array([10, 10]), 100)
    assert sum(t for _, t in plan) == 10 and all((c * np.array([30, 70])).sum() <= 100 for c, _ in plan)


def _greedy(cum, end, level, limit, overlap):
    """The same cuts one after the other."""
    out, s = [], 0
    while s != end:
        far = max(x for x in range(len(cum)) if cum[x] <= cum[s] + limit or x == s + 1)
        stop = far
        if far != end:
            for least in (3, 2, 1, 0):
                ok = [x for x in range(s + 1, far + 1) if level[x] >= least]
                if ok and cum[ok[-1]] - cum[s] > overlap + 2 * pieces.LONG:
                    stop = ok[-1]
                    break
        out.append((s, stop))
        if stop == end:
            break
        back = max(x for x in range(len(cum)) if cum[x] <= cum[stop] - overlap)
        s = back if back > s else stop
    return out


def test_pointer_doubling_equals_greedy():
    rng = random.Random(1)
    for _ in range(20):
        gaps = [rng.randrange(1, 17) for _ in range(rng.randrange(30, 400))]
        cum = np.append(0, np.cumsum(gaps))
        level = np.array([rng.choice([0, 1, 1, 1, 2, 3]) for _ in cum], np.int8)
        end = np.full(len(cum), len(cum) - 1)
        stop, follow = pieces._cut(cum, end, level, np.full(len(cum), 150), 40)
        seen = pieces._starts(follow, np.array([0]))
        seen[-1] = False
        got = [(int(s), int(stop[s])) for s in np.flatnonzero(seen)]
        assert got == _greedy(cum.tolist(), len(cum) - 1, level.tolist(), 150, 40)


def test_pieces(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = "\n\n".join(" ".join(" ".join(word() for _ in range(9)).capitalize() + rng.choice(".!?") for _ in range(6)) for _ in range(30))
    texts = {1: prose, 2: None, 3: "", 4: "short.", 5: "x" * 20_000, 6: "日本語の文。" * 500, 7: prose.replace("\n\n", "\r\n"), 8: "\n" * 3_000, 9: "a  b \t\n " * 800, 10: "ab1" * 4_000}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, prose, 0)], "k long, text string, piece int")
    rows = pieces.split_texts(df, "k", "text", 128, 16).collect()
    assert {r["id"] for r in rows} == {1, 5, 6, 7, 9, 10} | ({8} if MODEL.sizes([texts[8]])[0] > 128 else set())
    for k in {r["id"] for r in rows}:
        mine = sorted({(r["piece"], r["start_char"], r["end_char"], r["n_tokens"], r["repeated_tokens"], r["text"]) for r in rows if r["id"] == k})
        at = 0
        for p, a, b, n, shared, text in mine:
            assert text == texts[k][a:b] and n <= 128 and a <= at < b and n == MODEL.sizes([text])[0]
            assert p == 0 or shared >= 16 or a == at
            at = b
        assert at == len(texts[k])
    first = [r for r in rows if r["id"] == 1]
    assert all(r["text"].rstrip()[-1] in ".!?" for r in first)
    assert pieces.split_texts(df.limit(0), "k", "text").count() == 0
    with pytest.raises(ValueError):
        pieces.split_texts(df, "k", "text", 64, 64)


def test_other_kinds_of_vocabularies_are_refused():
    import pytest
    from caseloom.llm import bpe

    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe("/opt/tokenizers/word_bpe_49k.json")
