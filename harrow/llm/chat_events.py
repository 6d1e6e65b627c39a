"""Chat transcripts from event logs: events are folded into final messages, rendered by a template, and read back.

A log has a row an event: conv_id, place (the message's place in the conversation), message (its id), seq, kind, role, text, start,
length. Kinds:

- open: the message begins, with its role (and text, if any);
- delta: text is appended, as streams do;
- edit: length characters from start on become text (start null: the whole text does);
- regenerate: the text so far is thrown away;
- delete: the message is withdrawn.

Logs are partitioned by conversation and sorted by place, message and sequence. Partitions are ranges that are cut between messages,
so a hot conversation spreads over tasks; a task streams events and holds one message and one piece of output. Rendered
conversations are rows of pieces (whole turns, PIECE_TURNS of them or PIECE_CHARS characters): conv_id, part, piece, formatted, and the loss mask
as starts and ends of stretches of formatted. Most conversations are one piece.

The template marks every turn; control strings inside texts and roles are broken up by a backslash after their first character,
and backslashes are doubled, so no text can forge a mark and everything comes back as it was.

Defined results: null roles and texts are empty; events without seq or of other kinds are ignored, and of events of one message and seq the
first by kind and text counts once (logs are delivered at least once). Events of a message that was never opened open it with an empty role. Places
sort nulls first, equal places by message id. Events without conv_id are one conversation, whose id is null. An empty log gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .ordered import ordered_digests

PIECE_TURNS, PIECE_CHARS = 256, 256 << 10
#: Characters of a streamed delta, and deltas of a text at most.
DELTA, MOST_DELTAS = 512, 64


@dataclass(frozen=True)
class Template:
    """Marks before and after a text by role, and for other roles around role and text. No mark may hold a backslash, and each
    has to be set off from text by white space."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" [ANS] ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [END]")
    trained: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """All control strings, longest first."""
        found = {c for pair in [*self.marks.values(), self.other] for mark in pair for c in re.findall(r"<+/?\w+>+|\[/?\w+\]", mark)}
        return sorted(found, key=lambda c: (-len(c), c))


class Renderer:
    """Rendering, escaping and reading of one template."""

    def __init__(self, template: Template = Template()) -> None:
        self.template = template
        self.forged = re.compile("(?=" + "|".join(map(re.escape, template.controls())) + ")(.)", re.S)
        self.opening = re.compile("|".join(f"(?P<r{i}>{re.escape(m[0])})" for i, m in enumerate([*template.marks.values(), template.other])))
        self.roles = [*template.marks]

    def escape(self, text: str) -> str:
        return self.forged.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn's rendering, and where its text begins and ends in it."""
        escaped = self.escape(text)
        if role in self.template.marks:
            before, after = self.template.marks[role]
        else:
            a, b, after = self.template.other
            before = a + self.escape(role) + b
        return before + escaped + after, len(before), len(before) + len(escaped)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns of a rendering."""
        at = 0
        while at < len(formatted):
            m = self.opening.match(formatted, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            k, at = int(m.lastgroup[1:]), m.end()
            if k < len(self.roles):
                role, after = self.roles[k], self.template.marks[self.roles[k]][1]
            else:
                _, middle, after = self.template.other
                end = formatted.index(middle, at)
                role, at = self.unescape(formatted[at:end]), end + len(middle)
            end = formatted.index(after, at)
            yield role, self.unescape(formatted[at:end])
            at = end + len(after)


def fold(events: list[tuple]) -> tuple[str, str] | None:
    """(role, text) of a message's events (kind, role, text, start, length) in order; None if it was deleted."""
    role, parts, alive = "", [], True
    for kind, who, text, start, length in events:
        if kind == "open":
            role, parts = who or "", [text or ""]
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "regenerate":
            parts = []
        elif kind == "edit":
            whole = "".join(parts)
            a = 0 if start is None else max(0, start)
            b = len(whole) if start is None else a + max(0, length or 0)
            parts = [whole[:a], text or "", whole[b:]]
        elif kind == "delete":
            alive = False
    return (role, "".join(parts)) if alive else None


KINDS = ("open", "delta", "edit", "regenerate", "delete")
LOG = "conv_id long, place long, message string, seq long, kind string, role string, text string, start int, length int"


def event_log(conversations: DataFrame) -> DataFrame:
    """A log that amounts to the rows of conversations, as a chat service would have written it.

    Every row is a message, streamed in deltas. By a checksum of conversation and turn, some messages have a draft that is regenerated, some
    begin with a slip that is edited out, and some have a delta that was delivered twice.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), role.alias("role"), text.alias("whole"),
        F.concat_ws("-", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).substr(1, 16), F.monotonically_increasing_id().cast("string")).alias("message"),
        F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)).alias("way"),
    )
    size = F.greatest(F.lit(DELTA), F.ceil(F.length("whole") / MOST_DELTAS)).cast("int")
    event = lambda seq, kind, text=None, role=None, start=None, length=None: F.struct(
        F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(role).cast("string").alias("role") if role is None else role.alias("role"),
        (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(start).cast("int").alias("start"), F.lit(length).cast("int").alias("length"),
    )
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("whole") - 1, F.lit(0)) / size).cast("int")), lambda i: event(i + 4, "delta", F.substring("whole", i * size + 1, size)))
    slip = F.lit("\u2026")
    drafts = F.when(F.col("way") == 1, F.array(event(1, "delta", F.reverse(F.substring("whole", 1, 32))), event(2, "regenerate"))).when(F.col("way") == 2, F.array(event(1, "delta", slip)))
    after = F.when(F.col("way") == 2, F.array(event(1000, "edit", F.lit(""), start=0, length=1))).when(F.col("way") == 3, F.slice(deltas, 1, 1))
    none = F.array().cast("array<struct<seq:bigint,kind:string,role:string,text:string,start:int,length:int>>")
    events = F.concat(F.array(event(0, "open", role=F.col("role"))), F.coalesce(drafts, none), deltas, F.coalesce(after, none))
    return rows.select("conv_id", "place", "message", F.explode(events).alias("e")).select("conv_id", "place", "message", "e.*")


def render(log: DataFrame, template: Template = Template(), piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, part, piece, formatted, starts, ends: the conversations' pieces, in order of part and piece."""
    keys = ["conv_id", "place", "message"]
    dealt = log.filter(F.col("seq").isNotNull() & F.col("kind").isin(*KINDS)).select(*keys, "seq", "kind", "role", "text", "start", "length")
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys, "seq", "kind", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("formatted", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        renderer, part, rows, held, made = Renderer(template), TaskContext.get().partitionId(), [], 0, 0
        message, events, last_seq = None, [], None
        conv, out, n_turns, chars, starts, ends = None, [], 0, 0, [], []

        def close_piece() -> None:
            nonlocal out, n_turns, chars, starts, ends, held, made
            if n_turns:
                rows.append((conv, part, made, "".join(out), starts, ends))
                held, made = held + chars, made + 1
            out, n_turns, chars, starts, ends = [], 0, 0, [], []

        def close_message() -> None:
            nonlocal conv, n_turns, chars
            done = fold(events)
            if message[0] != conv:
                close_piece()
                conv = message[0]
            if done is None:
                return
            text, a, b = renderer.turn(*done)
            if done[0] in template.trained:
                starts.append(chars + a)
                ends.append(chars + b)
            out.append(text)
            n_turns, chars = n_turns + 1, chars + len(text)
            if n_turns >= piece_turns or chars >= piece_chars:
                close_piece()

        def batch_() -> pa.RecordBatch:
            nonlocal held
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)
            rows.clear()
            held = 0
            return b

        for batch in batches:
            for c, place, m, seq, *event in zip(*(x.to_pylist() for x in batch.columns)):
                if message != (c, place, m):
                    if message is not None:
                        close_message()
                    message, events, last_seq = (c, place, m), [], None
                if seq != last_seq:
                    events.append(tuple(event))
                    last_seq = seq
            if held > 4 << 20:
                yield batch_()
        if message is not None:
            close_message()
            close_piece()
        yield batch_()

    return dealt.mapInArrow(work, "conv_id long, part int, piece int, formatted string, starts array<int>, ends array<int>")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations, read from their text and mask.

    turns_sha256 is over role, line feed, text, line feed of each turn; loss_sha256 over the texts under the mask, unescaped.
    """

    def read(renderer: Renderer, text: str, starts: list[int], ends: list[int]) -> tuple[int, bytes, str]:
        turns = list(renderer.turns(text))
        return len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(renderer.unescape(text[a:b]) for a, b in zip(starts, ends))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator]]:
        renderer = Renderer(template)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                yield some, (read(renderer, *r) for r in zip(*(some.column(n).to_pylist() for n in ("formatted", "starts", "ends"))))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, read_ in texts(batches):
            found = [(n, hashlib.sha256(turns).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()) for n, turns, loss in read_]
            columns = list(zip(*found)) if found else [[]] * 4
            lengths = [len(x) for x in batch.column("formatted").to_pylist()]
            arrays = [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip([*columns, lengths], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, read_ in texts(batches):
            found = [(turns, loss.encode()) for _, turns, loss in read_]
            turns, loss = zip(*found) if found else ([], [])
            columns = [batch.column(n).cast(pa.int64()) for n in ("known", "id", "part", "piece")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(turns, pa.binary()), pa.array(loss, pa.binary())], ["known", "id", "part", "piece", "turns_sha256", "loss_sha256"])

    pieces = formatted.mapInArrow(counts, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    sums = [F.sum(n).alias(n) for n in ("n_turns", "loss_chars", "formatted_chars")]
    whole = table(pieces.groupBy("conv_id").agg(F.count("*").alias("n_pieces"), *sums, F.min("turns_sha256").alias("turns_sha256"), F.min("loss_sha256").alias("loss_sha256")), "read")
    one = whole.filter("n_pieces = 1").drop("n_pieces")
    # conversations in several pieces are read once more, and only they are brought into order
    many = whole.filter("n_pieces > 1").select(F.col("conv_id").alias("of"), *(s for s in ("n_turns", "loss_chars", "formatted_chars")))
    if many.isEmpty():
        out = one
    else:
        split = formatted.join(many.select("of"), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
        split = split.select(F.col("conv_id").isNotNull().cast("long").alias("known"), F.coalesce("conv_id", F.lit(0)).alias("id"), "part", "piece", "formatted", "starts", "ends")
        said = ordered_digests(split.mapInArrow(payloads, "known long, id long, part long, piece long, turns_sha256 binary, loss_sha256 binary"), ["known", "id"], ["part", "piece"], ["turns_sha256", "loss_sha256"])
        said = said.withColumn("conv_id", F.when(F.col("known") == 1, F.col("id"))).drop("known", "id")
        out = one.unionByName(many.join(said, F.col("of").eqNullSafe(F.col("conv_id"))).drop("of"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def format_chats(log: DataFrame, template: Template = Template(), piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Render a log into a written table of pieces and read it back."""
    return read_back(table(render(log, template, piece_turns, piece_chars), "formatted"), template)
