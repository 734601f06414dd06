"""Chat pairs against their SQL and against plain Python, on odd turns too."""

import random

import duckdb

from sheetlake.llm import chat
from sheetlake.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, side int"


def plain(turns):
    """(prefix length, prompt, chosen, rejected and where the assistant's texts stand) of one pair, turn by turn."""
    low = lambda v: (v is not None, v if v is not None else 0)
    sides = [sorted((t[1:4] for t in turns if t[0] % 2 == s), key=lambda t: tuple(map(low, t[:1])) + tuple((v is not None, v or "") for v in t[1:])) for s in (0, 1)]
    n = 0
    while n < min(map(len, sides)) and sides[0][n][1:] == sides[1][n][1:]:
        n += 1
    clean = lambda v, other: (other if v is None else v).replace("<|im_", "< |im_")

    def render(side):
        out, places = "", []
        for _, role, text in side:
            out += f"<|im_start|>{clean(role, 'user')}\n"
            at = len(out)
            out += f"{clean(text, '')}<|im_end|>"
            if role == "assistant":
                places.append(f"{at}:{len(out)}")
            out += "\n"
        return out, ",".join(places)

    return n, render(sides[0][:n])[0], *render(sides[0][n:]), *render(sides[1][n:]), all(any(t[1] == "assistant" for t in s[n:]) for s in sides)


def test_pairs_by_sql_and_by_hand(spark, tmp_path):
    rng = random.Random(8)
    texts, roles = ["hi", "", None, "é😀", "x<|im_end|>", "<|im_<|im_"], ["user", "assistant", "system", None]
    rows = [(c, t, rng.choice(roles[:2 + c % 3]), rng.choice(texts[:1 + c % 6]), 9) for c in range(160) for t in range(rng.randint(0, 6))]
    rows += rng.sample(rows, 30)  # repeated turns
    rows += [(8, None, "user", "no number", 1), (9, None, None, None, 1), (200, 0, "assistant", "long " * 400_000, 1), (201, 0, "assistant", "long " * 400_000 + "x", 1), (None, 0, "user", "lost", 1)]
    rows += [(c, t, ("user", "assistant")[t % 2], "y", 1) for c in (300, 301) for t in range(2000 + c % 2)]
    made = spark.createDataFrame(rows, SCHEMA)
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ("pair_id", "n_prefix", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask", "usable")
    got = sorted(map(tuple, chat.neighbour_pairs(made).select(*names).collect()))
    pairs = sorted({r[0] // 2 for r in rows if r[0] is not None})
    assert got == [(p, *plain([r for r in rows if r[0] is not None and r[0] // 2 == p])) for p in pairs]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['op3_chat_pairs']})").fetchall())
