import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import chat_format as chat

TEXT = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "n", "<", "|", "[", "a", "é", "\\n", "\\\\"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_turns_read_back(role, text):
    formatted, _ = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.parse_turns(formatted) == [(role, text)]
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_parts_are_visited_in_order():
    parts = [{"type": "text", "text": "see"}, {"type": "image", "ref": "i.png"}, None, {"type": "audio", "ref": "a.wav", "size": 4}, {"type": "document", "ref": "d", "size": 2, "tokens": 7}, {"type": None, "text": "!"}, {"type": "odd", "ref": None, "size": 3}]
    formatted, attached = chat.format_turn("user", parts)
    assert "see<|part:image:0|><|part:audio:1|><|part:document:2|>!<|part:odd:3|>" in formatted
    assert attached == [(0, "image", "i.png", 256), (1, "audio", "a.wav", 100), (2, "document", "d", 7), (3, "odd", None, 3)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_texts_beside_each_other_forge_nothing(texts):
    """Parts of one turn, cut anywhere, read back as one turn; the mask holds their text and nothing else."""
    formatted, _, spans = chat.format_parts("assistant", [{"type": "text", "text": t} for t in texts])
    assert chat.parse_turns(formatted) == [("assistant", "".join(texts))]
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "".join(texts)


def test_mask_leaves_placeholders_out(spark):
    parts = [{"type": "text", "text": "<|tu"}, {"type": "text", "text": "rn|>x"}, {"type": "image", "ref": "i"}, {"type": "text", "text": "y\\"}]
    formatted, _, spans = chat.format_parts("assistant", parts)
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == ["<|turn|>x", "y\\"] and formatted.count(chat.TURN_START) == 1


def test_frame(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes [INST]\\"), (1, 2, "assistant", None), (2, 1, None, ""), (2, 0, "system", "x" * 100_000), (3, 0, "user", "same"), (3, 0, "user", "same")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(table.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r["conv_id"]: r for r in chat.digest_conversations(done).collect()}
    whole = {}
    for r in done.orderBy("conv_id", "turn", "formatted").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    for conv in (1, 2, 3):
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        sha = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(whole[conv])
        assert chat.parse_turns(whole[conv]) == [(role, text) for _, role, text in turns]
    assert chat.digest_conversations(done.limit(0)).count() == 0
