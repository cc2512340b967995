"""Chat formatting at token level.

Each turn is ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Role and content are
encoded apart; the control marks are reserved ids after the vocabulary, spliced
in, so no text can spell them.  Inside texts every ``<`` + backslashes + ``|``
gets one backslash more, which makes the rendered form unambiguous and is
undone on reading.  The loss mask covers the content ids of assistant turns;
it and each turn's place follow from prefix sums of segment lengths.

A conversation is kept as one row per turn (with its offset), never as one
array, so a conversation of any length fits.

Defined results: null text or role is empty; a null turn comes first, ties are
ordered by role and the hash of the text; a null conv_id is a conversation of its own; rows are
kept as often as they came in; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

START, END = "<|im_start|>", "<|im_end|>"
_ESC, _UNESC = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def escape(text: str) -> str:
    return _ESC.sub(lambda m: "<" + m[1] + "\\|", text)


def unescape(text: str) -> str:
    return _UNESC.sub(lambda m: "<" + m[1][1:] + "|", text)


def turn_segments(enc, role: str, text: str, start_id: int, end_id: int) -> list[tuple[np.ndarray, bool]]:
    """(ids, under loss) of each segment of a turn, in order."""
    ids = lambda s: np.frombuffer(enc.encode(escape(s)), "<u4")
    mark = lambda *x: np.array(x, "<u4")
    line = np.frombuffer(enc.encode("\n"), "<u4")
    return [(mark(start_id), False), (ids(role), False), (line, False), (ids(text), role == "assistant"), (mark(end_id), False), (line, False)]


def format_turns(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row per turn of ``rows(conv_id, turn, role, text)``.

    conv_id, n (place from 0), ids, loss_start, loss_end (within the turn), n_chars, tokens_before (the turn's offset in its conversation).
    """
    small_batches(rows.sparkSession)
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])

    def run(batches):
        enc = encoder(tokenizer)
        base = enc.t.get_vocab_size()
        for b in batches:
            ids, lo, hi, chars, count = [], [], [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                role, text = role or "", text or ""
                seg = turn_segments(enc, role, text, base, base + 1)
                ends = np.cumsum([len(x) for x, _ in seg])
                ids.append(np.concatenate([x for x, _ in seg]).tobytes())
                lo.append(int(ends[2]))
                hi.append(int(ends[3]) if seg[3][1] else int(ends[2]))
                chars.append(len(START) + len(escape(role)) + 1 + len(escape(text)) + len(END) + 1)
                count.append(int(ends[-1]))
            yield pa.record_batch(
                {
                    "conv_id": b.column("conv_id"), "turn": b.column("turn"), "role": b.column("role"), "text_key": b.column("text_key"), "ids": pa.array(ids, pa.binary()), "loss_start": pa.array(lo, pa.int32()),
                    "loss_end": pa.array(hi, pa.int32()), "n_chars": pa.array(chars, pa.int64()), "n_tokens": pa.array(count, pa.int64()),
                }
            )

    # Text order only breaks ties, so its hash stands in for it in the sort.
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    made = keyed.mapInArrow(run, "conv_id long, turn long, role string, text_key long, ids binary, loss_start int, loss_end int, n_chars long, n_tokens long")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text_key")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("n", F.row_number().over(w) - 1).withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0).cast("long")))
    return made.drop("turn", "role", "text_key", "n_tokens")


class Decoder:
    """Reads turns back from ids alone."""

    def __init__(self, tokenizer: str):
        enc = encoder(tokenizer)
        self.t, self.base, self.line = enc.t, enc.t.get_vocab_size(), len(enc.encode("\n")) // 4

    def text(self, ids: np.ndarray) -> str:
        return self.t.decode(ids.tolist(), skip_special_tokens=False)

    def turn(self, ids: np.ndarray, lo: int, hi: int) -> tuple[str, str, str, int]:
        """(role, text, text under the loss, rendered characters)."""
        if ids[0] != self.base or (ids == self.base).sum() != 1 or (ids == self.base + 1).sum() != 1:
            raise ValueError("control ids are not where a turn has them")
        role, text = self.text(ids[1 : lo - self.line]), self.text(ids[lo : int(np.flatnonzero(ids == self.base + 1)[0])])
        return unescape(role), unescape(text), unescape(self.text(ids[lo:hi])), len(START) + len(role) + 1 + len(text) + len(END) + 1


def digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from the formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through in order; a task holds one turn and two running digests, whatever a conversation's length.
    """

    def run(batches):
        dec, key, state = Decoder(tokenizer), None, None

        def row():
            n, turns, chars, loss, total = state
            return pa.record_batch(
                {
                    "conv_id": pa.array([key[0]], pa.int64()), "n_turns": pa.array([n], pa.int64()), "turns_sha256": [turns.hexdigest()], "loss_chars": pa.array([chars], pa.int64()), "loss_sha256": [loss.hexdigest()],
                    "formatted_chars": pa.array([total], pa.int64()),
                }
            )

        for b in batches:
            done = []
            for conv, ids, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "loss_start", "loss_end")), strict=True):
                if key != (conv,):
                    if state:
                        done.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, chars = dec.turn(np.frombuffer(ids, "<u4"), lo, hi)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if state:
            yield row()

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.select("conv_id", "n", "ids", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "n")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
