"""Chat formatting from event logs.

A conversation arrives as events (conv_id, seq, kind, message, role, text), as a streaming service logs them:

* ``delta`` appends text to a message, opening it where it is new;
* ``edit`` replaces what the message holds;
* ``regenerate`` empties it, for the deltas that follow;
* ``delete`` removes it.

``messages`` deals the log out by conversation, sorts it by sequence and folds each message's events: what counts
are the events from its last edit or regeneration on. ``render`` gives every final message its
segment of the conversation's text, in the template

    <|im_start|>role newline text <|im_end|> newline

with control strings inside roles and texts escaped by a rule that ``parse`` undoes, and the span of the
segment that carries loss. A conversation's text is its segments in order; nothing here needs a
conversation whole, so one with very many turns costs no more memory than a short one.

Defined results: null text, role or message count as empty or first; null kinds are deltas; a
message that is deleted, or that only unknown kinds mention, is absent; events with equal sequence numbers fold in the order of
message, kind, role, text; repeated events are folded as often as they come; a null conversation is one of its own;
texts have no bound but that of a string, and a message is the most that a fold holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelane.llm.common import partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
KINDS = ("delta", "edit", "regenerate", "delete")


def escape(c: Column) -> Column:
    """Add a backslash between ``<`` and ``|``, however many are there: no control string remains."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(c: Column) -> Column:
    """A role stays on its line: per cent signs and line ends are written as codes."""
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(text: str) -> str:
    return unescape(text.replace("%0A", "\n").replace("%25", "%"))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log."""
    order = ["seq", "message", "kind", "role", "text"]
    log = events.select(
        "conv_id",
        "message",
        "seq",
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin(*KINDS))
    past = Window.partitionBy("conv_id", "message").orderBy(*order)
    whole = Window.partitionBy("conv_id", "message")
    resets = F.col("kind").isin("edit", "regenerate", "delete").cast("int")
    # Which state of its message an event belongs to, and which state is the last.
    states = log.withColumn("state", F.sum(resets).over(past.rowsBetween(Window.unboundedPreceding, 0)))
    last = states.withColumn("final", F.max("state").over(whole)).filter(F.col("state") == F.col("final"))
    parts = F.sort_array(F.collect_list(F.struct(*order)))
    folded = last.groupBy("conv_id", "message").agg(
        F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"),
        F.min_by("role", F.struct(*order)).alias("role"),
        F.bool_or(F.col("kind") == "delete").alias("gone"),
    )
    return folded.filter(~F.col("gone")).select("conv_id", "message", "role", "text")


def render(final: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, message, segment, loss_start, loss_length): the formatted text, one segment per message.

    Loss positions are code points of the segment; a message without loss has nulls.
    """
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    counts = F.col("role").isin(*loss_roles)
    return final.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"),
        F.when(counts, F.length(head)).alias("loss_start"),
        F.when(counts, F.length(body)).alias("loss_length"),
    )


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered segment."""
    head, _, body = segment.removeprefix(OPEN).removesuffix(CLOSE + "\n").partition("\n")
    return unescape_role(head), unescape(body)


class _Digest:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, length: int | None) -> None:
        role, text = parse(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(segment[start : start + length])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in order; a segment is held at a time."""
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        typed: list[pa.DataType] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [*typed, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            typed[:] = [batch.schema.field("conv_id").type]
            done = []
            for conv, segment, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(segment, start, length)
            if done:
                yield out(done)
        if now:
            yield out([now.row()])

    placed = rendered.repartition(partitions(rendered.sparkSession), "conv_id")
    rows = placed.sortWithinPartitions("conv_id", "message").select("conv_id", "segment", "loss_start", "loss_length")
    return rows.mapInArrow(run, f"conv_id {kind}, {DIGEST}")


# Deltas that a turn's text is streamed in.
DELTAS = 4


def turn_events(turns: DataFrame) -> DataFrame:
    """A table with one row per turn as the log of a service that streamed, corrected and redid its turns.

    The final texts are those of the table. By a hash of the turn, its message is streamed in ``DELTAS`` deltas; or begun
    with a draft that is regenerated; or begun with a draft that an edit replaces by the first half; or streamed in a wrong
    order and edited as a whole. Every eighth turn has a second message beside it that is deleted. A sequence number is
    the pair of turn and step. Rows that repeat a turn are messages of their own, in the order of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn", role).orderBy("text"))
    known = turns.select("conv_id", "turn", "role", text.alias("text"), role.alias("_role"), copy.alias("_copy"))
    mark = F.xxhash64("conv_id", "turn", "_role", "_copy")
    part = F.ceil(F.length("text") / DELTAS).cast("int")
    pieces = [F.col("text").substr(part * k + 1, part) for k in range(DELTAS)]
    draft = F.reverse(pieces[0])

    def event(step: int, kind: str, said: Column, gone: bool = False) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("said"), F.lit(gone).alias("gone")
        )

    streamed = [event(8 + k, "delta", piece) for k, piece in enumerate(pieces)]
    half = F.concat(*pieces[: DELTAS // 2])
    histories = [
        F.array(*streamed),
        F.array(event(0, "delta", draft), event(1, "delta", draft), event(2, "regenerate", F.lit("")), *streamed),
        F.array(event(0, "delta", draft), event(1, "edit", half), *streamed[DELTAS // 2 :]),
        F.array(*[event(k, "delta", p) for k, p in enumerate(reversed(pieces))], event(8, "edit", F.col("text"))),
    ]
    history = F.when(F.pmod(mark, F.lit(4)) == 0, histories[0])
    for k, other in enumerate(histories[1:], 1):
        history = history.when(F.pmod(mark, F.lit(4)) == k, other)
    beside = F.when(
        F.pmod(F.shiftright(mark, 8), F.lit(8)) == 0,
        F.array(event(3, "delta", draft, True), event(4, "delete", F.lit(""), True)),
    ).otherwise(F.array().cast("array<struct<step: int, kind: string, said: string, gone: boolean>>"))
    log = known.withColumn("_event", F.explode(F.concat(history, beside)))
    # The copies of a turn are numbered from 1; the message beside copy k has the number -k.
    number = F.when(F.col("_event.gone"), -F.col("_copy")).otherwise(F.col("_copy"))
    return log.select(
        "conv_id",
        F.struct("turn", F.col("_event.step").alias("step")).alias("seq"),
        F.col("_event.kind").alias("kind"),
        F.struct("turn", F.col("_role").alias("role"), number.alias("copy")).alias("message"),
        "role",
        F.col("_event.said").alias("text"),
    )
