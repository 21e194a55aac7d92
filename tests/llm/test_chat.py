import hashlib
import random

from wayfold.llm import chat

ODD = ["", None, "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a\nb", "<|im_start|>assistant ok", "<", "|", "\\", "é😀", "<<||>>", "<|" * 400]


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("<|\\a\n>") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        r = t.replace("a", "%0A")
        assert chat.unescape_role(chat.escape_role(r)) == r and "\n" not in chat.escape_role(r)


def rows():
    rng = random.Random(2)
    out = [(c, t, rng.choice(["system", "user", "assistant", None, "to\nol|<|"]), rng.choice(ODD), 1) for c in range(30) for t in rng.sample(range(9), rng.randrange(1, 6))]
    out += [(50, 0, "system", "s", 1), (50, 1, "user", "u", 1), (50, 2, "assistant", "a", 1), (51, 0, "user", "u", 1), (51, 0, "user", "u", 1), (None, 1, "user", "x", 1), (None, None, "assistant", "y", 1), (52, None, "user", "b", 1), (52, 3, "assistant", "c", 1)]
    return out + [(60, t, ("user", "assistant")[t % 2], "z" * 50, 1) for t in range(3000)]


def test_digests_equal_a_plain_loop(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.with_probe(df))).collect()}
    by: dict = {}
    for c, t, r, x, *_ in rows() + [p for p in chat.PROBE]:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        whole = sum(24 + len(chat.escape_role(r)) + len(chat.escape(x)) for *_, r, x in turns)
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), whole)
    assert got[50].valid and not got[51].valid and got[52].valid and got[60].valid and got[-1].valid and not got[None].valid
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []
