"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, slices
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import drop_staged, stage

#: The strings that mark turns, and others that a model may take for marks.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = [OPEN, CLOSE, END, "<s>", "<unk>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_RAW = re.compile("([<\\[])(\\\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPED = re.compile("([<\\[])\\\\(\\\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")


def escape(text: str) -> str:
    """One more backslash after the first character of every control string, escaped or not.

    No rest of a control string holds ``<``, ``[`` or a backslash, so matches never overlap, the
    result holds no control string, and ``unescape`` is the exact inverse.
    """
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


EXAMPLES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("context_chars", T.LongType()),
        T.StructField("added", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


#: Replies of a conversation that one task formats; a longer conversation is divided among several.
REPLIES = 64
FRONT = T.StructType([T.StructField("_range", T.LongType()), *EXAMPLES.fields])


def expand(turns: DataFrame, trainable: str = "assistant", replies: int = REPLIES) -> DataFrame:
    """One example for every turn of the role ``trainable``: all turns before it as context, its text as target.

    A turn is written ``[INST]role[/INST]text</s>``, with control strings escaped inside role and text.
    The full text of example k is that of example k-1, then ``added`` (the formatted turns since, and the target's
    own opening), then ``target``; only the characters ``loss_start`` to ``loss_end`` of the full text, which
    are the escaped reply without marks, bear loss. The examples of a conversation share their
    context this way, so the output grows with the turns, not with their square; ``full_texts`` writes them out.
    Turns after the last reply come in a row without target: nothing of it is trained on.

    Turns are ordered by turn (nulls first), then role, then text, so repeated rows have a defined place. Null
    role or text counts as empty; a null conv_id is a conversation of its own. Replies are numbered in one
    global order, so no task sorts a whole conversation; ranges of ``replies`` of them, each with the turns that lead up to them, are formatted
    apart, and a range's place in its conversation is added from a row for each range. A task streams through a range and holds no more than the longest
    stretch between replies. Other columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = prefix_sum(rows, ["conv_id", "turn", "role", "text"], F.col("role") == trainable, "_reply")
    ranges = numbered.withColumn("_range", F.expr(f"_reply div {replies}"))
    dealt = ranges.repartition("conv_id", "_range").sortWithinPartitions("conv_id", "_reply", "turn", "role", "text").select("conv_id", "_range", "_reply", "role", "text")
    front = stage(dealt.mapInArrow(_formatter(trainable), FRONT), "turns")
    drop_staged(numbered)
    size = F.sum(F.length("added") + F.length(F.coalesce("target", F.lit(""))))
    # a row for each range: what its conversation holds before it, and the number of the conversation's first reply
    upto = Window.partitionBy("conv_id").orderBy("_range")
    sizes = front.groupBy("conv_id", "_range").agg(size.alias("_size"), F.min("example").alias("_first"))
    places = sizes.select(F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), (F.sum("_size").over(upto) - F.col("_size")).alias("_before"), F.min("_first").over(upto).alias("_zero"))
    placed = front.join(places, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    moved = {c: F.col(c) + F.col("_before") for c in ("context_chars", "loss_start", "loss_end")} | {"example": F.col("example") - F.col("_zero")}
    return placed.withColumns(moved).select(*EXAMPLES.names)


def _formatter(trainable: str):
    """Of rows (conversation, range, replies before, role, text) in order: examples with offsets counted from the range's start."""
    opening = f"{OPEN}{escape(trainable)}{CLOSE}"

    def run(batches):
        key, number, length, added = None, None, 0, []
        out: list[tuple] = []

        def rest():
            if added:
                text = "".join(added)
                out.append((key[1], key[0], number, length + len(text), text, None, None, None))

        for batch in slices(batches, 4096):
            for conv_id, part, reply_no, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (conv_id, part) != key:
                    rest()
                    key, length, added = (conv_id, part), 0, []
                number, reply = reply_no, escape(text)
                if role == trainable:
                    before = "".join([*added, opening])
                    length += len(before)
                    out.append((part, conv_id, number, length, before, reply + END, length, length + len(reply)))
                    length += len(reply) + len(END)
                    added = []
                else:
                    added.append(f"{OPEN}{escape(role)}{CLOSE}{reply}{END}")
            if out:
                yield _batch(out, FRONT.names, FRONT)
                out = []
        rest()
        if out:
            yield _batch(out, FRONT.names, FRONT)

    return run


FULL = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)
#: Characters of written-out examples that a batch may hold before it goes on.
FLUSH = 1 << 22


def full_texts(examples: DataFrame, replies: int = REPLIES) -> DataFrame:
    """Columns conv_id, example, text, loss_start, loss_end: every example with its whole context written out.

    This grows with the square of a conversation's turns, as such examples do; use it for what is trained on next. Turns after the last reply are left out.
    """
    return _written(examples.where("target is not null"), replies)


def written_out(turns: DataFrame, trainable: str = "assistant", replies: int = REPLIES) -> DataFrame:
    """One row for every turn of the role ``trainable``: ``text`` is its whole context and its reply, ready to train on alone.

    The rules are those of ``expand``. Turns after the last reply come alone in a row without loss span.
    """
    return _written(expand(turns, trainable, replies), replies)


def _written(examples: DataFrame, replies: int) -> DataFrame:
    """Each range of ``replies`` examples is written by one task, which first reads what its conversation holds before it.

    Ranges but a conversation's last send their turns to the later ones: one turn to as many tasks as ranges follow, a small share (1 in ``replies``) of
    what is written. A task holds one context at a time.
    """
    own = examples.select(*FULL.names[:2], "added", "target", *FULL.names[3:], F.expr(f"example div {replies}").alias("_to"), F.lit(True).alias("_own"))
    last = own.where("target is not null").groupBy(F.col("conv_id").alias("_c")).agg(F.max("_to").alias("_last")).where("_last > 0")
    later = F.explode(F.sequence(F.col("_to") + 1, F.col("_last")))
    sent = own.join(last, F.col("conv_id").eqNullSafe(F.col("_c"))).where("_to < _last and target is not null").select(*own.columns[:6], later.alias("_to"), F.lit(False).alias("_own"))
    dealt = own.unionByName(sent).repartition("conv_id", "_to").sortWithinPartitions("conv_id", "_to", "example")

    def run(batches):
        key, context, out, size = None, "", [], 0
        for batch in slices(batches, 4096):
            for conv_id, example, added, target, a, b, to, is_own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (conv_id, to) != key:
                    key, context = (conv_id, to), ""
                if target is not None:
                    context += added + target
                if is_own:
                    out.append((conv_id, example, added if target is None else context, a, b))
                    size += len(out[-1][2])
                if size > FLUSH:
                    yield _batch(out, FULL.names, FULL)
                    out, size = [], 0
        if out:
            yield _batch(out, FULL.names, FULL)

    return dealt.mapInArrow(run, FULL)


PARTS = T.StructType([*EXAMPLES.fields, T.StructField("text_chars", T.LongType()), T.StructField("before_sha256", T.BinaryType()), T.StructField("text_sha256", T.BinaryType())])


def read_written(full: DataFrame, trainable: str = "assistant") -> DataFrame:
    """What ``read_back`` says, read from written-out examples; ``formatted_chars`` counts all characters of all of them.

    Each example is divided where its last earlier reply ends; the text before must have the digest of the whole example before it,
    so every example is shown to hold its whole context. Only the parts and digests are sent on, not the texts.
    """
    mark = f"{OPEN}{escape(trainable)}{CLOSE}"

    def run(batches):
        for batch in slices(batches, 256):
            out = []
            for conv, example, text, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a is None:
                    out.append((conv, example, None, text, None, None, None, len(text), None, None))
                    continue
                if not text.endswith(mark, 0, a) or text[b:] != END:
                    raise ValueError("a loss span is not a reply without its marks")
                last = text.rfind(mark, 0, a - len(mark))
                cut = text.index(END, last) + len(END) if last >= 0 else 0
                digests = [hashlib.sha256(x.encode("utf-8", "replace")).digest() for x in (text[:cut], text)]
                out.append((conv, example, a, text[cut:a], text[a:], a, b, len(text), *digests))
            if out:
                yield _batch(out, PARTS.names, PARTS)

    return _read(full.select(*FULL.names).mapInArrow(run, PARTS))


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(?:(.*?)" + re.escape(END) + ")?", re.DOTALL)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns, what bears loss, and the characters written.

    ``turns_sha256`` is over role, newline, text, newline of each turn; ``loss_sha256`` over all text under
    the loss spans, unescaped, in order. Each example's spans must lie where its context ends. An empty table gives no rows.
    A digest of a whole conversation can only be taken in order, so its parts (never its written-out texts) stream through one task, an example at a time.
    """
    return _read(examples)


def _read(examples: DataFrame) -> DataFrame:
    dealt = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    names, given = DIGESTS.names, examples.columns

    def run(batches):
        conv, state, out = None, None, []
        for batch in slices(batches, 4096):
            r = batch.to_pydict()
            for row in zip(*[r[n] for n in given], strict=True):
                if state is None or row[0] != conv:
                    if state is not None:
                        out.append(state.result(conv))
                    conv, state = row[0], _Reader()
                state.read(*row[2:])
            if out:
                yield _batch(out, names, DIGESTS)
                out = []
        if state is not None:
            yield _batch([state.result(conv)], names, DIGESTS)

    return dealt.mapInArrow(run, DIGESTS)


class _Reader:
    def __init__(self):
        self.turns, self.chars, self.loss, self.n_turns, self.n_loss = hashlib.sha256(), 0, hashlib.sha256(), 0, 0
        self.written, self.before = 0, hashlib.sha256().digest()

    def read(self, context_chars, added, target, loss_start, loss_end, text_chars=None, before=None, whole=None):
        for role, text in _TURN.findall(added + (target or "")):
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.n_turns += 1
        if context_chars is None:
            context_chars = self.chars + len(added)
        if self.chars + len(added) != context_chars or before not in (None, self.before):
            raise ValueError("an example's context is not the text of those before it")
        if target is not None:
            under = unescape(target[loss_start - context_chars : loss_end - context_chars])
            self.loss.update(under.encode())
            self.n_loss += len(under)
        self.chars += len(added) + len(target or "")
        self.written += len(added) + len(target or "") if text_chars is None else text_chars
        self.before = whole or self.before

    def result(self, conv):
        return (conv, self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.written)


def _batch(rows: list[tuple], names: list[str], schema: T.StructType) -> pa.RecordBatch:
    types = arrow_schema(schema).types
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
