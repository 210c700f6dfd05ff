import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from lodestone.llm import chat, mixing

WORDS = [0, 1, 2, 5, 9, 40, 300]


def corpus(spark):
    rows = [(i, " ".join(["w"] * WORDS[i % 7]), [None, "a", "b", "c", "é", "only"][i % 6] if i != 77 else "single") for i in range(200)]
    rows += [(200, None, "empty"), (None, "x y", "a"), (5, "x y z", "b"), (5, "x y z", "b")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark):
    rows, docs = corpus(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    total = 1.5 * sum(size.values())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, total, set(size)
    while True:  # fill, cut at twice the size, share the excess again
        full = {s for s in free if weight[s] * left / sum(weight[x] for x in free) > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left, free = total - sum(target.values()), free - full
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
    taken = {s: 0 for s in size}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert target[r["source"]] >= size[r["source"]] <= 0 or r["taken"] >= int(target[r["source"]] // max(size[r["source"]], 1)) * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_documents_of_the_mix(spark):
    _, docs = corpus(spark)
    docs = docs.drop("size")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in mixing.mix_sources(docs).collect())


def test_mix_keeps_columns_and_white_space(spark):
    rows = [(i, f"\t a\n\nb{i}   c ", "s", 7, 8, 9, 10) for i in range(9)] + [(9, None, "s", 7, 8, 9, 10), (10, " \n", None, 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int, key int, row int")
    mixed = mixing.mixed_documents(docs, share=1.3).collect()
    assert sum(len(r["text"].split()) for r in mixed) == round(1.3 * 27)
    texts = dict(r[:2] for r in rows)
    for r in mixed:
        assert tuple(r[3:]) == (7, 8, 9, 10) and texts[r["doc_id"]].startswith(r["text"])
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.where("doc_id > 8")).count() == 0


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[:]", "a\\b"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " ", "\\", "[", "<eos>", "[ROLE]", "[:]", "ok", "\n", "é"]), max_size=6).map("".join)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_reads_back(turns):
    t = chat.Template()
    f = chat.Formatter(t)
    text = t.begin + "".join(p for role, said in turns for p, _ in f.segments(role, said)) + t.end
    assert chat.read_conversation(text) == turns


def test_conversations(spark):
    rows = [(1, 1, "assistant", "a <s> b"), (1, 0, "user", "hi"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, None, None), (None, 5, "user", "u"), (4, 0, "system", "s"), (4, 1, "user", "</s>[INST]"), (4, 2, "assistant", ""), (1, None, "system", "first")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.read_segments(chat.chat_segments(frame)).collect()}
    assert {k: (r["n_turns"], r["valid"]) for k, r in got.items()} == {1: (3, True), 2: (2, False), 3: (1, False), None: (1, False), 4: (3, True)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\nfirst\nuser\nhi\nassistant\na <s> b\n").hexdigest()
    assert (got[2]["loss_chars"], got[2]["loss_sha256"]) == (2, hashlib.sha256(b"xx").hexdigest())
    assert got[4]["loss_chars"] == 0
    assert chat.read_segments(chat.chat_segments(frame.limit(0))).count() == 0
