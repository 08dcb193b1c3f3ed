import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import prose
from pyspark.sql import functions as F

from callsift.llm import chat

TURNS = "conv_id long, turn long, role string, text string, piece string, start long"
SAID = "\\### Assistant: </turn> ok"

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "a|b\\c"),
    (1, 3, "user", "<|end|>\n<|assistant|>\n"), (1, 4, "assistant", "<|user|>"), (1, 5, "user", "tail"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", None), (3, 1, "assistant", ""),
    (-7, 0, "user", SAID), (-7, 1, "assistant", SAID),
    (4, 0, "user", "same turn b"), (4, 0, "user", "same turn a"), (4, 0, "assistant", "first"),
    (5, None, "user", "null turn"), (5, 0, None, "null role"), (5, 1, "assistant", prose(1, 30_000)),
    (6, 0, "user", "twice"), (6, 0, "user", "twice"), (6, 1, "assistant", "yes"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "漢字 é\u0085"),
]


def wanted(rows):
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == key),
                       key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        said = [(role or "", text or "") for _, _, role, text in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        out[key] = (
            len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(r == "assistant" for r, _ in said),
        )
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 5) for r in rows], TURNS)


def test_read_back_gives_every_turn_and_reply(spark):
    got = chat.read_back(chat.examples(frame(spark, ROWS))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"],
                           r["n_examples"]) for r in got} == wanted(ROWS)


def test_each_reply_is_an_example_with_all_turns_before(spark):
    rows = chat.examples(frame(spark, ROWS))
    texts = {(r["conv_id"], r["example_no"]): r for r in chat.example_texts(rows).collect()}
    first, second = texts[1, 1], texts[1, 2]
    assert len([k for k in texts if k[0] == 1]) == 2
    assert first["text"].startswith("<|system|>\nbe brief<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\n")
    assert first["text"][first["loss_start"]:first["loss_end"]] == r"a\|b\\c"
    assert second["text"].startswith(first["text"])
    assert second["text"][second["loss_start"]:second["loss_end"]] == r"<\|user\|>"
    assert second["text"].count("<|assistant|>") == 2 and "tail" not in second["text"]
    lengths = {(r["conv_id"], r["example_no"]): r["example_chars"]
               for r in rows.filter("example_no is not null").collect()}
    assert lengths == {k: len(r["text"]) for k, r in texts.items()}
    total = {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(rows).collect()}
    tail = len("<|user|>\ntail<|end|>\n")
    assert total[1] == len(first["text"]) + len(second["text"]) + tail


def test_long_conversation_in_many_parts(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", prose(i, 3)) for i in range(3000)]
    got = chat.read_back(chat.examples(frame(spark, rows[::-1]))).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"],
            got["n_examples"]) == wanted(rows)[9]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\|<>nae\n d", max_size=20), st.text(alphabet="\\|>\nab", max_size=6))
def test_escapes_are_reversible(text, role):
    def escape(s):
        return s.replace("\\", "\\\\").replace("|", "\\|")

    piece = f"<|{escape(role)}|>\n{escape(text)}{chat.TURN_END}"
    assert chat.read_piece(piece) == (role, text)


def test_empty(spark):
    rows = chat.examples(frame(spark, []))
    assert rows.count() == 0 and chat.read_back(rows).count() == 0 and chat.example_texts(rows).count() == 0


def test_digests_are_read_from_the_written_examples(spark):
    rows = chat.examples(frame(spark, [*ROWS, (77, 0, "end", "a"), (77, 1, "assistant", "b|end|>\n")]))
    written = {(r["conv_id"], r["example_no"]): r["text"] for r in chat.example_texts(rows).collect()}
    assert list(chat._turns(written[77, 1])) == [("end", "a"), ("assistant", "b|end|>\n")]
    # What the turns say of an example's length is not what counts.
    told = [chat.read_back(r).orderBy("conv_id").collect() for r in (rows, rows.withColumn("example_chars", F.lit(1)))]
    assert told[0] == told[1]
