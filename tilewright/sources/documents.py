"""Single large documents read by many tasks: YAML manifests by lines, GeoJSON collections by byte ranges. What cannot be read is a row, not an error."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import stage
from tilewright.sources.committed import file_system, text_lines
from tilewright.sources.readers import SPLITS, parsed_features

# --- manifests ---------------------------------------------------------------------------------------------
#: A line of a manifest as it is usually written: indent, then a key with or without a value, or an item.
KEY, ITEM = r"^( *)([A-Za-z_][\w-]*):(?: +(.*))?$", r"^( *)- +(.*)$"
LISTS = ("images", "labels", "probability")
_PLACE, _LINE = 1 << 31, (1 << 31) - 1
#: Tables of heads are broadcast up to so many rows.
FEW = 100_000


def _scalar(text: Column) -> Column:
    """The value of a YAML scalar on one line: JSON-like or single quotes, null, or plain text without a comment."""
    plain = F.trim(F.regexp_replace(text, r"(^|\s)#.*$", ""))
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_extract(text, r'^("(?:[^"\\]|\\.)*")', 1), F.lit("}")), "$.v")
    single = F.regexp_replace(F.regexp_extract(text, r"^'((?:[^']|'')*)'", 1), "''", "'")
    return F.when(text.startswith('"'), quoted).when(text.startswith("'"), single).when(plain.isin("", "null", "~", "Null", "NULL"), F.lit(None)).otherwise(plain)


def read_large_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of YAML manifests in block style, however large one document is: files, or a document that was committed in parts.

    ``rows`` are those of ``read_manifest`` with the document's ``path``: dataset, prefix, split, pos, image, label, probability. Lines are read in blocks of
    files by many tasks, numbered by one range sort, and given to the list whose head comes before them; a document has a few heads, which are gathered for each
    document, items are not. Lists of a split are put side by side by position; where one is shorter its value is null. ``rejects`` has path, line,
    value and problem: lines that are no key, item, comment or blank line (texts over several lines, say), lists in brackets, items before any key,
    and probabilities that are no number (these keep their row, with a null). A blank or comment line takes no position.
    """
    raw = text_lines(spark, path).withColumnRenamed("document", "path")
    item = F.col("value").rlike(ITEM)
    # lines and items are counted by one sum: the number of items in the upper bits
    numbered = prefix_sum(raw, ["path", "part", "block", "place"], F.when(item, _PLACE + 1).otherwise(F.lit(1)), out="_sum")
    lines = numbered.select("path", "value", F.col("_sum").bitwiseAND(F.lit(_LINE)).alias("at"), F.shiftright("_sum", 31).alias("n"))
    kind = F.when(F.col("value").rlike(ITEM), "item").when(F.col("value").rlike(KEY), "key").when(F.col("value").rlike(r"^\s*(#.*)?$|^---\s*$"), "blank").otherwise("broken")
    lines = stage(lines.withColumn("kind", kind), "lines")
    part = lambda k: F.regexp_extract("value", KEY, k)
    key = F.struct("at", "n", F.length(part(1)).alias("depth"), part(2).alias("key"), part(3).alias("text"))
    heads = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "key", key))).alias("h"), F.min("at").alias("first"))
    of = lambda name: _scalar(F.element_at(F.filter("h", lambda k: (k["key"] == name) & (k["depth"] == 0)), 1)["text"])

    def list_of(k: Column, i: Column) -> Column:
        above = F.filter(F.slice("h", 1, i), lambda p: p["depth"] < k["depth"])
        return F.struct(k["at"].alias("at"), k["n"].alias("n"), F.when(F.size(above) > 0, F.element_at(above, -1)["key"]).alias("split"), k["key"].alias("list"))

    heads = heads.select("path", "first", _optional(of, "name").alias("dataset"), _optional(of, "prefix").alias("prefix"), F.transform("h", list_of).alias("lists"))
    heads = stage(heads, "heads")
    small = F.broadcast(heads) if heads.count() <= FEW else heads
    found = lines.where("kind <> 'blank'").join(small, "path", "left")
    held = F.filter("lists", lambda k: k["at"] < F.col("at"))
    found = found.withColumn("l", F.when(F.size(held) > 0, F.element_at(held, -1)))
    listed = F.col("l.split").isin(*SPLITS) & F.col("l.list").isin(*LISTS)
    text = _scalar(F.regexp_extract("value", ITEM, 2))
    items = found.where((F.col("kind") == "item") & listed).select("path", "dataset", "prefix", F.col("l.split").alias("split"), (F.col("n") - F.col("l.n")).alias("pos"), F.col("l.list").alias("list"), text.alias("text"), "value", "at", "first")
    pick = lambda name: F.max(F.when(F.col("list") == name, F.col("text")))
    rows = items.groupBy("path", "dataset", "prefix", "split", "pos").agg(pick("images").alias("image"), pick("labels").alias("label"), pick("probability").alias("_p"))
    rows = rows.select("path", "dataset", "prefix", "split", "pos", "image", "label", F.expr("try_cast(_p as double)").alias("probability"))
    broken = found.where("kind = 'broken'").withColumn("problem", F.lit("no key, item or comment"))
    loose = found.where("kind = 'item' and l is null").withColumn("problem", F.lit("an item before any key"))
    inline = found.where((F.col("kind") == "key") & part(2).isin(*LISTS) & part(3).rlike(r"^[^\s#]") & (part(3) != "[]")).withColumn("problem", F.lit("a list that is not in lines of its own"))
    numbers = items.where("list = 'probability' and text is not null and try_cast(text as double) is null").withColumn("problem", F.lit("no number"))
    line_no = (F.col("at") - F.col("first")).alias("line")
    bad = [d.select("path", line_no, "value", "problem") for d in (broken, loose, inline, numbers)]
    return rows, reduce(DataFrame.unionByName, bad)


def _optional(of, name: str) -> Column:
    """The first head of that name at the top of a document, null where there is none."""
    some = F.exists("h", lambda k: (k["key"] == name) & (k["depth"] == 0))
    return F.when(some, of(name))


# --- GeoJSON -------------------------------------------------------------------------------------------------
def byte_ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, no, start, stop, length), staged: each file of a path in ranges of ``size`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    parts = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("no", "start"))
    return stage(parts.select("path", "no", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"), "length"), "ranges")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges dealt out in order: one a task where they are large, as many as come to TASK_BYTES, but no more than TASK_RANGES, where they are small."""
    n, size = ranges.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
    return ranges.repartitionByRange(max(1, -(-(size or 0) // TASK_BYTES), -(-n // TASK_RANGES)), "path", "no")


def _open(path: str):
    where, name = file_system(path)
    return where.open_input_file(name)


def _escaped(f, start: int) -> bool:
    """Whether the byte at ``start`` stands behind an odd number of backslashes."""
    n = 0
    while start - n > 0:
        low = max(0, start - n - 4096)
        f.seek(low)
        back = f.read(start - n - low)
        run = len(back) - len(back.rstrip(b"\\"))
        n += run
        if run < len(back):
            break
    return n % 2 == 1


def scan_json(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of quotes that open or close strings, places of { and [, places of } and ]); the last two without regard to strings."""
    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 0x22)
    if b"\\" in data or escaped:
        slash = a == 0x5C
        # the length of the run of backslashes in front of each quote
        last = np.where(slash, -1, np.arange(len(a)))
        last = np.maximum.accumulate(last)
        before = np.where(quotes > 0, last[quotes - 1], -1) if len(quotes) else np.zeros(0, dtype=np.int64)
        run = quotes - 1 - before
        run = run + ((before == -1) & escaped)
        quotes = quotes[run % 2 == 0]
    return quotes, np.flatnonzero((a == 0x7B) | (a == 0x5B)), np.flatnonzero((a == 0x7D) | (a == 0x5D))


def _outside(places: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    return places[(np.searchsorted(quotes, places) + inside) % 2 == 0]


#: Bytes, and ranges, that a task looks through.
TASK_BYTES, TASK_RANGES = 32 << 20, 512
STATE = "path string, no int, flips boolean, deeper long, deeper_inside long"
FOUND = "path string, start long, value string"


def read_feature_collections(spark: SparkSession, path: str, properties: str, chunk: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of GeoJSON documents, each read by as many tasks as it has ranges of ``chunk`` bytes.

    A range is looked through once for what it does to the state of a reader: whether it ends inside a string, and how much deeper in brackets, if it began outside
    of a string or inside. A few numbers a range come together to give each the state that it begins in; then every task finds the features that begin in its
    range, reading on to the end of the last. Features are the objects two brackets deep whose type is Feature, as ``read_features`` gives them;
    other objects there are passed over. ``rejects`` has path, start (byte) and value of objects that are no JSON, or that the file ends in. Files are UTF-8; ``path`` is what
    both Spark and Arrow's file systems know (file, hdfs, s3, gs).
    """
    ranges = byte_ranges(spark, path, chunk)

    def look(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    escaped = _escaped(f, r["start"])
                    f.seek(r["start"])
                    quotes, down, up = scan_json(f.read(r["stop"] - r["start"]), escaped)
                deeper = [len(_outside(down, quotes, inside)) - len(_outside(up, quotes, inside)) for inside in (False, True)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((r["path"], r["no"], len(quotes) % 2 == 1, *deeper), (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "no", "flips", "deeper", "deeper_inside"])

    # a row for each range of a file: a terabyte in ranges of 32 MB has some 30,000
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    seen = _dealt(ranges).mapInArrow(look, STATE).withColumn("inside", inside).withColumn("_d", F.when(F.col("inside"), F.col("deeper_inside")).otherwise(F.col("deeper")))
    states = seen.select("path", "no", "inside", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("depth"))
    work = _dealt(stage(ranges.join(states, ["path", "no"]), "work"))

    def find(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    rows = list(_objects(f, r))
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(rows), pa.string()), pa.array([s for s, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())], names=["path", "start", "value"])

    objects = stage(work.mapInArrow(find, FOUND), "objects")
    kind = F.get_json_object("value", "$.type")
    ok = F.get_json_object("value", "$").isNotNull()
    features = parsed_features(objects.where(ok & (kind == "Feature")), properties)
    return features, objects.where(~ok)


def _objects(f, r: dict):
    """(first byte, text) of the objects two brackets deep that begin in a range; one that the file ends in as far as it goes."""
    escaped = _escaped(f, r["start"])
    f.seek(r["start"])
    data, inside, depth = f.read(r["stop"] - r["start"]), r["inside"], r["depth"]
    quotes, down, up = scan_json(data, escaped)
    down, up = _outside(down, quotes, inside), _outside(up, quotes, inside)
    at = np.concatenate([down, up])
    change = np.concatenate([np.ones(len(down), dtype=np.int64), -np.ones(len(up), dtype=np.int64)])
    order = np.argsort(at)
    at, level = at[order], depth + np.cumsum(change[order])
    first = at[(level == 3) & (change[order] == 1)]
    first = first[np.frombuffer(data, np.uint8)[first] == 0x7B]
    last = at[(level == 2) & (change[order] == -1)]
    stop = np.searchsorted(last, first)
    for k, a in zip(stop.tolist(), first.tolist(), strict=True):
        if k < len(last):
            yield r["start"] + a, data[a : last[k] + 1].decode("utf-8", "replace")
        else:
            yield r["start"] + a, _rest(f, r, data[a:])


def _rest(f, r: dict, part: bytes) -> str:
    """An object that goes on behind the range."""
    f.seek(r["stop"])
    while True:
        # looked through as a whole: it may grow over some ranges, but is one feature
        quotes, down, up = scan_json(part, False)
        down, up = _outside(down, quotes, False), _outside(up, quotes, False)
        at = np.concatenate([down, up])
        level = np.cumsum(np.concatenate([np.ones(len(down), dtype=np.int64), -np.ones(len(up), dtype=np.int64)])[np.argsort(at)])
        ends = np.flatnonzero(level == 0)
        if len(ends):
            return part[: int(np.sort(at)[ends[0]]) + 1].decode("utf-8", "replace")
        more = f.read(max(1 << 16, len(part)))
        if not more:
            return part.decode("utf-8", "replace")
        part += more
