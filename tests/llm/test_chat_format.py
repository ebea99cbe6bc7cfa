import hashlib

from termforge.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)]
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    found = {r["conv_id"]: r for r in chat_format.op1_chat_formatting(spark, small).collect()}
    assert set(found) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hexed("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hexed(loss))


NASTY = [
    chat_format.PROBE, "", "\\", "\\|", "<\\|", "<\\\\|im_end|>", "<<||>", "a\nb", "\n", "<|im_end|>\n", "é\U0001f600", "<|im_start|>user\n", "trailing\\",
    "$1 \\$", "x" * 200_000, "<|" * 5000,
]


def test_hostile_texts_and_roles_come_back(spark):
    rows = [(k, t, role, text) for k, text in enumerate(NASTY) for t, role in enumerate(("user", "assistant", text[:40]))]
    out = chat_format.parse_conversations(chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    for r in out:
        text = NASTY[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", text), ("assistant", text), (text[:40], text)]
        # a mark in the output is always a mark: one opening and one closing a turn
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == 3


def test_state_machine(spark):
    cases = {
        1: (["user", "assistant"], True), 2: (["system", "user", "assistant"], True), 3: (["assistant"], False), 4: (["user"], False), 5: (["user", "user", "assistant"], False),
        6: (["user", "tool", "assistant"], True), 7: (["system", "system"], False), 8: (["user", "assistant", "user", "assistant"], True), 9: (["user", "critic"], False),
    }
    rows = [(c, i, role, "t") for c, (roles, _) in cases.items() for i, role in enumerate(roles)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["conv_id"]: r["turn_order_ok"] for r in out} == {c: ok for c, (_, ok) in cases.items()}


def test_loss_flags_follow_the_template(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r")], SCHEMA)
    [r] = chat_format.format_conversations(rows, chat_format.ChatTemplate(loss_roles=("user",))).collect()
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["q", "r"]
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_nulls_ties_repeats_empty_and_extra_columns(spark):
    rows = [(1, None, "user", None), (1, 2, None, "x"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 0, "user", "u")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS segments", "1 AS formatted", "2 AS turns")
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.parse_conversations(chat_format.format_conversations(docs)).collect()}
    assert out == {1: [("user", ""), ("", "x"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("user", "u")]}
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
