"""Chat formatting with shared beginnings, as a prefix tree of turns.

A turn is written as ``<|im_start|>role``, a line end, the text and ``<|im_end|>`` with a
line end. Control strings inside roles and texts get a backslash after their first
character - one more if some are there already - so reading takes one away again.

Conversations that share their first turns share the nodes of a tree. A node is known
by the digest of its path, so turns meet by one aggregation and no pairs are made:

1. each conversation's turns pass one task in order, as a stream: the path digest of
   every turn, its token ids, nothing held but the last digest;
2. grouping by digest gives the nodes with the number of conversations through them;
   the child that most conversations take is its parent's heavy child, so a path
   leaves the chain of heavy children at most log2(conversations) times;
3. the conversations pass once more: the exits from chains make up a node's place in
   depth-first order, and the tokens before it its position;
4. a segmented scan over that order gives each node its place in the tree's packed
   token sequence. A node's tokens appear once, depth first; a chain is contiguous.

A token may attend to its own node up to itself and to the ancestors' intervals: one
interval per chain on the path.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.plans.prefix import keyed_running
from quarry.sources.files import drop_table, materialize, scratch_path

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that a text must not hold as they are: those of this template and of other common ones.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose texts are trained on.
LEARNT = "assistant"


def checked(controls: tuple[str, ...]) -> tuple[str, ...]:
    """Escaping is reversible if no control string holds a backslash or may begin inside another."""
    for a in controls:
        for i in range(1, len(a)):
            if any(a[i:].startswith(b) or b.startswith(a[i:]) for b in controls):
                raise ValueError(f"a control string may begin inside {a!r}")
    if any(not c or "\\" in c for c in controls):
        raise ValueError("a control string is empty or holds a backslash")
    return controls


def _split(controls: tuple[str, ...]) -> str:
    """First characters and the rest of each control string, as an alternation with the backslashes between."""
    by: dict[str, list[str]] = {}
    for c in checked(controls):
        by.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"{re.escape(first)}(?=\\\\*(?:{'|'.join(rest)}))" for first, rest in by.items())


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text with a backslash after the first character of each control string, escaped ones too."""
    return F.regexp_replace(text, f"({_split(controls)})", r"$1\\")


def unescape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """The text whose :func:`escape` this is."""
    pattern = _split(controls).replace("(?=\\\\*", "(?=\\\\\\\\*")
    return re.sub(f"({pattern})\\\\", r"\1", text)


def _moved(conv, last, first):
    return first or conv != last


def _keyed(shared, end_ids: bytes):
    """Streams ordered turns: path digests, token ids of head, text and end, and the tokens of each."""
    def run(batches):
        encoder = bpe.Encoder(shared.value)
        conv, key, at, first = None, b"", 0, True
        for batch in batches:
            n = batch.num_rows
            ids = batch.column("conv").to_pylist()
            heads, texts = batch.column("head").to_pylist(), batch.column("body").to_pylist()
            out = {c: [] for c in ("at", "key", "parent", "root", "token_ids", "n_head", "n_body")}
            coded = []
            for lot in _lots(heads, texts):
                coded += encoder.many(lot)
            for i in range(n):
                if _moved(ids[i], conv, first):
                    conv, key, at, first, root = ids[i], b"", 0, False, None
                parent, head, body = key, heads[i].encode(), texts[i].encode()
                key = hashlib.blake2b(parent + struct.pack(">Q", len(head)) + head + body, digest_size=16).digest()
                root = root or key
                a, b = coded[2 * i], coded[2 * i + 1]
                for c, x in zip(out, (at, key, parent or None, root, a + b + end_ids, len(a) // 4, len(b) // 4), strict=True):
                    out[c].append(x)
                at += 1
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *[pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)],
                                              batch.column("learnt")], names=["conv", *out, "learnt"])

    return run


def _lots(heads, texts):
    lot, size = [], 0
    for h, t in zip(heads, texts, strict=True):
        lot += [h, t]
        size += len(h) + len(t)
        if size >= bpe.AT_ONCE:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


_FAR = (1 << 64) - 1


def _placed(batches):
    """Streams ordered turns with their nodes' counts: the chain and place of each node, tokens before it, and the conversation's last node."""
    conv, first = None, True
    chain, tokens = b"", 0
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("conv", "at", "key", "n", "through", "light", "mine")}
        keep = {"chain": [], "outer": [], "outer_tokens": [], "before": []}
        for i in range(batch.num_rows):
            if _moved(cols["conv"][i], conv, first):
                conv, first, chain, tokens, outer, start = cols["conv"][i], False, b"", 0, [], 0
            if cols["light"][i]:  # leaves the chain: what lies deeper on it comes first, then fuller children
                outer = [*outer, (chain, tokens - start)]
                chain += b"\x01" + struct.pack(">QQ", _FAR - cols["at"][i], _FAR - cols["through"][i]) + cols["key"][i]
                start = tokens
            keep["chain"].append(chain)
            keep["outer"].append([c for c, _ in outer])
            keep["outer_tokens"].append([t for _, t in outer])
            keep["before"].append(tokens)
            tokens += cols["n"][i]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv", "at", "root", "n", "through", "mine")], pa.array(keep["chain"], pa.binary()),
             pa.array(keep["outer"], pa.list_(pa.binary())), pa.array(keep["outer_tokens"], pa.list_(pa.int64())), pa.array(keep["before"], pa.int64())],
            names=["conv", "at", "root", "n", "through", "mine", *keep])


@dataclass
class Packed:
    """``nodes``: one row a distinct turn in its place of the tree; ``ends``: one row a conversation.

    nodes  tree, chain, start, end (token places in the tree's sequence), position (of the
           first token, counted along the conversation), depth, through (conversations),
           token_ids (little-endian uint32), learn_from, learn_to (places of the tokens
           under the loss mask; null: none) and ancestors, the intervals of the tree's
           sequence that the node's tokens attend to beside their own node.
    ends   conv_id, tree, chain, end (where its last turn ends), n_turns, and attends:
           the intervals that make up the conversation, in order, with their chains.
    """

    nodes: DataFrame
    ends: DataFrame


def turns_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def pack(rows: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         controls: tuple[str, ...] = CONTROLS, learnt: str = LEARNT) -> Packed:
    """All conversations as packed prefix trees of tokens of the byte-level BPE file ``vocabulary``.

    A conversation is the rows of one ``conv_col``, in the order of turn (null first), role
    and text; null roles and texts count as empty; rows without a conversation id are one
    conversation, whose id is null. Repeated rows are turns of their own. Conversations of
    any length pass as streams. Of children that equally many conversations take, the one
    with the larger digest is heavy. Other columns play no part. An empty table gives
    empty results.
    """
    spark = rows.sparkSession
    words = bpe.vocabulary(vocabulary)
    controls = checked(tuple(dict.fromkeys([*controls, *words.added])))
    end_ids = bpe.Encoder(words).many([END])[0]
    shared = bpe.df_broadcast(rows, words)
    turns = turns_of(rows, conv_col, turn_col, role_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(turns.dtypes)["conv"]
    # A line end in a role would end the head: it is written as a control character that roles do not hold unescaped.
    role = F.replace(F.replace(escape(F.col("role"), controls), F.lit("\x1b"), F.lit("\x1bx")), F.lit("\n"), F.lit("\x1bn"))
    ready = turns.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text") \
        .select("conv", F.concat(F.lit(START), role, F.lit(MIDDLE)).alias("head"), escape(F.col("text"), controls).alias("body"),
                (F.col("role") == learnt).alias("learnt"))
    told = f"conv {kind}, at long, key binary, parent binary, root binary, token_ids binary, n_head int, n_body int, learnt boolean"
    coded = materialize(ready.mapInArrow(_keyed(shared, end_ids), told))
    n = F.expr("octet_length(token_ids) div 4").cast("long")
    steps = coded.select("conv", "at", "key", "parent", "root", n.alias("n"))

    found_path = scratch_path(spark, "nodes")
    found = materialize(steps.groupBy("key", "parent").agg(F.count(F.lit(1)).alias("through"), F.min(F.struct("conv")).alias("first")), found_path)
    forks = found.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("key", F.struct("through", "key")).alias("heavy"), F.count(F.lit(1)).alias("children")) \
        .where("children > 1").select("parent", "heavy")
    # Only shared nodes and light children need looking up; a turn of one conversation alone is on its chain.
    known = found.join(forks, "parent", "left").select("key", "through", "first", F.coalesce(F.col("key") != F.col("heavy"), F.lit(False)).alias("light")) \
        .where("through > 1 OR light")
    looked = steps.join(known, "key", "left").select(
        "conv", "at", "key", "root", "n", F.coalesce("through", F.lit(1)).cast("long").alias("through"), F.coalesce("light", F.lit(False)).alias("light"),
        (F.col("through").isNull() | F.struct("conv").eqNullSafe(F.col("first"))).alias("mine"))
    told = f"conv {kind}, at long, root binary, n long, through long, mine boolean, chain binary, outer array<binary>, outer_tokens array<long>, before long"
    placed_path = scratch_path(spark, "places")
    placed = materialize(looked.repartition(parts, "conv").sortWithinPartitions("conv", "at").mapInArrow(_placed, told), placed_path)
    drop_table(spark, found_path)

    # Depth first: a chain's own nodes by depth, then what leaves it.
    order = F.concat(F.col("chain"), F.lit(b"\x00"), F.unhex(F.lpad(F.hex("at"), 16, "0")))
    mine = placed.where("mine").withColumn("order", order)
    run_path = scratch_path(spark, "sequence")
    run = materialize(keyed_running(mine, ["root"], ["order"], {"end": F.col("n")}).withColumn("start", F.col("end") - F.col("n")), run_path)
    tops = run.groupBy("root", "chain").agg(F.min("start").alias("top"))
    # The intervals of a chain's ancestors: one row a (chain, chain before it), joined to where that one begins.
    before = run.where(F.size("outer") > 0).groupBy("root", "chain").agg(F.any_value("outer").alias("outer"), F.any_value("outer_tokens").alias("outer_tokens")) \
        .select("root", "chain", F.posexplode(F.arrays_zip("outer", "outer_tokens")).alias("place", "x")) \
        .select("root", "chain", "place", F.col("x.outer").alias("from_chain"), F.col("x.outer_tokens").alias("tokens"))
    begun = tops.select("root", F.col("chain").alias("from_chain"), F.col("top").alias("from_top"))
    ahead = before.join(begun, ["root", "from_chain"]).groupBy("root", "chain").agg(F.array_sort(F.collect_list(F.struct(
        "place", F.col("from_top").alias("start"), (F.col("from_top") + F.col("tokens")).alias("end"), F.col("from_chain").alias("chain")))).alias("ahead"))
    chains = materialize(tops.join(ahead, ["root", "chain"], "left"))
    outer = F.transform("ahead", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["chain"].alias("chain")))
    own = F.array(F.struct(F.col("top").alias("start"), F.col("stop").alias("end"), F.col("chain").alias("chain")))
    spans = F.filter(F.when(F.col("ahead").isNull(), own).otherwise(F.concat(outer, own)), lambda x: x["end"] > x["start"])
    texts = coded.select("conv", "at", "token_ids", "n_head", "n_body", "learnt")
    whose = [run["conv"].eqNullSafe(texts["conv"]), run["at"] == texts["at"]]
    nodes = run.join(texts, whose).drop(texts["conv"]).drop(texts["at"]).withColumn("stop", F.col("start")).join(chains, ["root", "chain"])
    learns = lambda to: F.when(F.col("learnt"), F.col("start") + F.col("n_head") + to)
    nodes = nodes.select(
        F.hex("root").alias("tree"), "chain", "start", "end", F.col("before").alias("position"), F.col("at").cast("long").alias("depth"), "through",
        "token_ids", learns(F.lit(0)).alias("learn_from"), learns(F.col("n_body")).alias("learn_to"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("ancestors"))
    # A conversation ends on the chain of its last turn, as many tokens below the chain's top as the path has there.
    inner = F.col("before") + F.col("n") - F.aggregate("outer_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    ends = placed.groupBy("conv").agg(F.max_by(F.struct("root", "chain", "at", inner.alias("tokens")), "at").alias("x")).select("conv", "x.*") \
        .join(chains, ["root", "chain"]).withColumn("stop", F.col("top") + F.col("tokens")) \
        .select(F.col("conv").alias(conv_col), F.hex("root").alias("tree"), "chain", F.col("stop").alias("end"), (F.col("at") + 1).alias("n_turns"),
                spans.alias("attends"))
    packed = Packed(materialize(nodes), materialize(ends))
    for path in (placed_path, run_path):
        drop_table(spark, path)
    return packed


def _read(shared, controls: tuple[str, ...]):
    """Streams the nodes of conversations in order; decodes, checks and parses each turn, and digests the conversation."""
    def run(batches):
        words = shared.value
        conv, first, held = None, True, None
        out = [[] for _ in range(6)]

        def closed():
            turns, whole, learnt, chars, formatted = held
            for column, x in zip(out, (conv, turns, whole.hexdigest(), chars, learnt.hexdigest(), formatted), strict=True):
                column.append(x)

        def flushed(kind):
            done = pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()),
                                               pa.array(out[4], pa.string()), pa.array(out[5], pa.int64())],
                                              names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            for column in out:
                column.clear()
            return done

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            ids, raw = batch.column("conv").to_pylist(), batch.column("token_ids").to_pylist()
            lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            for i in range(batch.num_rows):
                if _moved(ids[i], conv, first):
                    if held:
                        closed()
                    conv, first, held = ids[i], False, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text, size = parsed(words.decode(raw[i]), controls)
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode())
                if lows[i] is not None:
                    said = unescape(words.decode(raw[i][4 * lows[i]:4 * highs[i]]), controls)
                    held[2].update(said.encode())
                    held[3] += len(said)
                held[4] += size
            yield flushed(kind)
        if held:
            closed()
            yield flushed(kind)

    return run


def parsed(turn: str, controls: tuple[str, ...] = CONTROLS) -> tuple[str, str, int]:
    """(role, text, characters) of one formatted turn."""
    if not turn.startswith(START) or not turn.endswith(END):
        raise ValueError("not a formatted turn")
    role, text = turn[len(START):-len(END)].split(MIDDLE, 1)
    role = re.sub("\x1b(.)", lambda m: {"n": "\n", "x": "\x1b"}[m[1]], role)
    return unescape(role, controls), unescape(text, controls), len(turn)


def read_back(packed: Packed, vocabulary: str, conv_col: str = "conv_id", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Per conversation, from the packed tokens: id, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Each conversation gathers the nodes in its attention intervals, in order; the turns are
    decoded, parsed and unescaped, and the tokens under the loss mask decoded by themselves.
    """
    words = bpe.vocabulary(vocabulary)
    controls = checked(tuple(dict.fromkeys([*controls, *words.added])))
    shared = bpe.df_broadcast(packed.nodes, words)
    spans = packed.ends.select(F.col(conv_col).alias("conv"), "tree", F.explode("attends").alias("x")) \
        .select("conv", "tree", F.col("x.chain").alias("chain"), F.col("x.start").alias("lo"), F.col("x.end").alias("hi"))
    nodes = packed.nodes.select("tree", "chain", "start", "end", "position", "token_ids", (F.col("learn_from") - F.col("start")).cast("int").alias("low"),
                                (F.col("learn_to") - F.col("start")).cast("int").alias("high"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = spans.join(nodes, ["tree", "chain"]).where("start >= lo AND end <= hi").select("conv", "position", "token_ids", "low", "high")
    kind = dict(seen.dtypes)["conv"]
    told = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    done = seen.repartition(parts, "conv").sortWithinPartitions("conv", "position").mapInArrow(_read(shared, controls), told)
    return done.withColumnRenamed("conv", conv_col)


def formatted_texts(packed: Packed, vocabulary: str, conv_col: str = "conv_id") -> DataFrame:
    """(id, position, text): the formatted turns of each conversation, decoded from the packed tokens."""
    spans = packed.ends.select(conv_col, "tree", F.explode("attends").alias("x")).select(conv_col, "tree", "x.*").withColumnsRenamed({"start": "lo", "end": "hi"})
    seen = spans.join(packed.nodes, ["tree", "chain"]).where("start >= lo AND end <= hi").select(conv_col, "position", "token_ids")
    return bpe.decode(seen, vocabulary, text_col="text").drop("token_ids")
