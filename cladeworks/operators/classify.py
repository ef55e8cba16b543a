"""Assign a taxon to each read by a weighted vote over the tree.

Reads are cut into token runs in chunks. A chunk sends each of its distinct minimizers once to the index
(one shuffle on the minimizer, no hot key: a frequent one comes once per chunk) and waits as one packed row; the taxa
found come back to it (one shuffle on the chunk). There, whole arrays at a time: with hits H
(taxon -> tokens) the score of a hit taxon is the sum of H over its path; the candidate is the lowest common
ancestor of all best taxa; the call is the deepest node at or above it whose clade holds at least
ceil(confidence * tokens). The tree is broadcast as preorder ranges up to ``tree.MOST_NODES`` nodes; beyond, the hits
are joined to their paths and voted on by expressions (``resolve``), with equal results.

Defined cases: reads without tokens are unclassified with the hit list "0:0"; an empty index classifies
nothing; null sequences count as empty; every read of the input comes out once (read ids are distinct, or
shared by mates).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cladeworks.functions.hashing import unsigned_at_least, with_hash
from cladeworks.functions.kmers import Scheme
from cladeworks.operators.taxonomy import lca_of_paths
from cladeworks.operators.tokens import frames_of, sequence_runs
from cladeworks.operators.tree import Tree, small_tree

MATE_BORDER, FRAME_BORDER = "|:|", "-:-"
#: Letters of reads packed into one row.
CHUNK = 1 << 18


def mask_quality(reads: DataFrame, minimum: int) -> DataFrame:
    """Letters of base quality below ``minimum`` become x; rows need ``seq`` and ``qual`` of equal length.

    Rows without quality or with an empty sequence stay as they are.
    """
    if minimum <= 0:
        return reads
    at = reads.columns.index("seq"), reads.columns.index("qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, quals = (b.column(i).to_pylist() for i in at)
            new = []
            for s, q in zip(seqs, quals):
                if s and q is not None:
                    letters, quality = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (s, q))
                    if len(letters) != len(quality):
                        raise ValueError("sequence and quality differ in length")
                    s = np.where(quality < 33 + minimum, np.uint8(ord("x")), letters).tobytes().decode("latin-1")
                new.append(s)
            yield b.set_column(at[0], b.schema.field(at[0]), pa.array(new, b.schema.field(at[0]).type))

    return reads.mapInArrow(run, reads.schema)


def pair_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of two files paired by their ordinal: both mates under the first's id, mates 1 and 2.

    Unequal files are an error, told by the ordinal that has no mate.
    """
    from cladeworks.functions.columns import trim_mate

    a = first.select("ordinal", trim_mate(F.col("id")).alias("read_id"), F.col("seq").alias("s1"))
    b = second.select("ordinal", F.col("seq").alias("s2"))
    j = a.join(b.withColumn("_b", F.lit(True)), "ordinal", "full")
    alone = F.col("read_id").isNull() | F.col("_b").isNull()
    rid = F.when(alone, F.raise_error(F.concat(F.lit("no mate for record "), F.col("ordinal").cast("string")))).otherwise(F.col("read_id"))
    return j.select(rid.alias("read_id"), F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("s1").alias("seq")), F.struct(F.lit(2).alias("mate"), F.col("s2").alias("seq")))).alias("m")).select("read_id", "m.mate", "m.seq")


def pair_interleaved(reads: DataFrame) -> DataFrame:
    """Adjacent records of one file as mates."""
    n = F.floor(F.col("ordinal") / 2)
    return pair_mates(reads.where("ordinal % 2 = 0").withColumn("ordinal", n), reads.where("ordinal % 2 = 1").withColumn("ordinal", n))


def _vote(hits: Column) -> Column:
    """Candidate path: of the lowest common ancestor of the best-scoring taxa; null without hits.

    One fold over the scored hits keeps the best score and the common path of all that reach it.
    """

    def score(h: Column) -> Column:
        return F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(F.array_contains(h["path"], x["taxon"]), x["n"]).otherwise(0))

    scored = F.transform(hits, lambda h: F.struct(score(h).alias("best"), h["path"].alias("path")))
    kind = "struct<best:bigint,path:array<bigint>>"

    def better(acc: Column, s: Column) -> Column:
        tied = F.struct(acc["best"].alias("best"), F.array_intersect(acc["path"], s["path"]).alias("path"))
        return F.when(s["best"] > acc["best"], s).when(s["best"] == acc["best"], tied).otherwise(acc).cast(kind)

    start = F.struct(F.lit(-1).cast("bigint").alias("best"), F.array().cast("array<bigint>").alias("path")).cast(kind)
    return F.aggregate(scored, start, better)["path"]


def resolve(df: DataFrame, hits: str, total: str, confidence: float) -> DataFrame:
    """Append ``candidate``, ``call`` and ``clade_hits`` (hits at or under the call)."""
    d = df.withColumn("_path", F.when(F.size(hits) > 0, _vote(F.col(hits))))
    need = F.ceil(F.lit(float(confidence)) * F.col(total))

    def clade(a: Column) -> Column:
        return F.aggregate(F.col(hits), F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(F.array_contains(x["path"], a), x["n"]).otherwise(0))

    steps = F.transform("_path", lambda a: F.struct(a.alias("taxon"), clade(a).alias("n")))
    enough = F.filter(steps, lambda s: s["n"] >= need)
    last = F.try_element_at(enough, F.lit(-1))
    return d.withColumn("candidate", F.try_element_at("_path", F.lit(-1))).withColumn("call", last["taxon"]).withColumn("clade_hits", last["n"]).drop("_path")


def hit_lists(runs: DataFrame) -> DataFrame:
    """``read_id, hits``: text of each read's runs (read_id, order, border, code, n).

    Neighbours of equal code become one item; ``border`` (null, "|" or "-") stands before the run it is on.
    Runs of n 0 only carry a border. One window over the read's runs, partitioned like the gathering after it.
    """
    w = Window.partitionBy("read_id").orderBy("order")
    new = F.col("border").isNotNull() | F.lag("code").over(w).isNull() | (F.lag("code").over(w) != F.col("code"))
    t = runs.withColumn("new", new.cast("int"))
    t = t.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = t.groupBy("read_id", "island").agg(F.first("code").alias("code"), F.sum("n").alias("n"), F.max("border").alias("border"))
    mark = F.when(F.col("border").isNotNull(), F.concat("border", F.lit(":"), "border", F.lit(" "))).otherwise("")
    text = F.rtrim(F.concat(mark, F.when(F.col("n") > 0, F.concat("code", F.lit(":"), F.col("n").cast("string"))).otherwise("")))
    lists = items.withColumn("text", text).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("island", "code", "text"))).alias("i"))
    joined = F.array_join(F.transform("i", lambda x: x["text"]), " ")
    return lists.select("read_id", F.when(F.element_at("i", -1)["code"] == "A", F.concat(joined, F.lit(" "))).otherwise(joined).alias("hits"))


def lookup(runs: DataFrame, index: DataFrame, least_hash: int = 0) -> DataFrame:
    """Append ``taxon`` to token runs. Ambiguous runs do not take part in the join, so they make no hot key."""
    clear = runs.where("minimizer IS NOT NULL")
    if least_hash:
        clear = with_hash(clear, "minimizer").withColumn("minimizer", F.when(unsigned_at_least("hash", least_hash), F.col("minimizer"))).drop("hash")
        skipped = clear.where("minimizer IS NULL").withColumn("skipped", F.lit(True))
        clear = clear.where("minimizer IS NOT NULL").withColumn("skipped", F.lit(False))
        rest = runs.where("minimizer IS NULL").withColumn("skipped", F.lit(False)).unionByName(skipped)
    else:
        rest = runs.where("minimizer IS NULL").withColumn("skipped", F.lit(False))
        clear = clear.withColumn("skipped", F.lit(False))
    hit = clear.join(index.select("minimizer", "taxon"), "minimizer", "left").withColumn("ambiguous", F.lit(False))
    kind = index.schema["taxon"].dataType.simpleString()
    rest = rest.withColumn("taxon", F.lit(None).cast(kind)).withColumn("ambiguous", ~F.col("skipped"))
    return hit.unionByName(rest)


def _per_read(reads: DataFrame) -> DataFrame:
    """``read_id, seqs``: the mates' sequences in order. Reads without mates are not shuffled."""
    paired = reads.where("mate > 0").limit(1).count() > 0
    if not paired:
        return reads.select("read_id", F.array("seq").alias("seqs"))
    mates = F.sort_array(F.collect_list(F.struct("mate", F.coalesce("seq", F.lit("")).alias("seq"))))
    return reads.groupBy("read_id").agg(mates.alias("m")).select("read_id", F.col("m.seq").alias("seqs"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _chunk_rows(source: DataFrame, scheme: Scheme, translated: bool) -> DataFrame:
    """``minimizer, chunk, slot, ids, data``: a row per distinct minimizer of a chunk (data null) and a packed
    row per chunk, whose minimizer is negative and in no index."""
    kind = source.schema["read_id"].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, lists = b.column(0), b.column(1).to_pylist()
            size, first = 0, 0
            for i, seqs in enumerate(lists):
                size += sum(len(x or "") for x in seqs)
                if size >= CHUNK or i + 1 == len(lists):
                    number += 1
                    yield chunk(number, ids.slice(first, i + 1 - first), lists[first : i + 1])
                    size, first = 0, i + 1

    def chunk(number: int, ids: pa.Array, lists: list[list[str | None]]) -> pa.RecordBatch:
        flat = [x or "" for seqs in lists for x in seqs]
        read = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        mate = np.concatenate([np.arange(len(x)) for x in lists]) if flat else read
        seqs, row, frame = frames_of(flat, translated)
        o, m, amb, n, lookup = sequence_runs(seqs, scheme)
        distinct, slot = np.unique(m[~amb], return_inverse=True)
        of = np.full(len(o), -1, np.int32)
        of[~amb] = slot
        data = _pack(read=read[row[o]].astype(np.int32), mate=mate[row[o]].astype(np.int32), frame=frame[o].astype(np.int8), n=n.astype(np.int64), slot=of, lookup=lookup, seq_read=read.astype(np.int32), letters=np.array([len(x) for x in flat], np.int64))
        k = len(distinct)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[distinct.view(np.int64), -1 - number]), pa.array(np.full(k + 1, number)), pa.array(np.arange(k + 1, dtype=np.int32)), pa.array([None] * k + [ids.to_pylist()], arrow), pa.array([None] * k + [data], pa.binary())],
            ["minimizer", "chunk", "slot", "ids", "data"],
        )

    return source.mapInArrow(run, f"minimizer bigint, chunk bigint, slot int, ids array<{kind.simpleString()}>, data binary")


def _hit_texts(read: np.ndarray, border: np.ndarray, code: np.ndarray, n: np.ndarray, reads: int) -> list[str]:
    """Hit list of every read; codes are tax ids, 0 for none and -1 for ambiguous; border 1 (mate), 2 (frame) or 0."""
    texts = ["0:0"] * reads
    if not len(read):
        return texts
    new = np.r_[True, (read[1:] != read[:-1]) | (code[1:] != code[:-1])] | (border > 0)
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at)
    distinct, of = np.unique(code[at], return_inverse=True)
    names = ["A" if c < 0 else str(c) for c in distinct.tolist()]
    marks = ["", MATE_BORDER + " ", FRAME_BORDER + " "]
    items = [f"{marks[x]}{names[c]}:{k}" for x, c, k in zip(border[at].tolist(), of.tolist(), total.tolist())]
    r = read[at]
    edges = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    for a, b in zip(edges.tolist(), np.r_[edges[1:], len(r)].tolist()):
        texts[r[a]] = " ".join(items[a:b]) + (" " if code[at[b - 1]] < 0 else "")
    return texts


_COUNTS = "length string, n_tokens bigint, n_ambiguous bigint, hit_groups bigint, total bigint, quick bigint, text string"


def classify(reads: DataFrame, index: DataFrame, taxonomy: DataFrame, scheme: Scheme, confidence: float = 0.0, min_hit_groups: int = 2, quick: bool | str = False, translated: bool = False, least_hash: int = 0, compat: bool = True, denominator: str = "tokens", min_quality: int = 0) -> DataFrame:
    """One row per read: ``read_id, status, taxon, length, n_tokens, n_ambiguous, hit_groups, candidate,
    clade_hits, hits``.

    ``compat`` keeps known habits of the search this follows: translated searches count 3 tokens more per
    mate, ambiguous tokens count in the denominator (``denominator="documented"`` leaves them out).
    ``quick`` calls the taxon of the first look-up that reaches ``min_hit_groups`` groups; as "compat" it stops there
    too, but votes on the hits before it. ``least_hash`` is that of a
    downsampled index: minimizers it cannot hold are not looked up. ``min_quality`` masks letters by ``qual``.
    """
    if not 0 <= confidence <= 1 or min_hit_groups < 0:
        raise ValueError("confidence must be within 0 and 1, min_hit_groups not negative")
    if quick not in (False, True, "compat"):
        raise ValueError("quick must be False, True or 'compat'")
    if denominator not in ("tokens", "documented"):
        raise ValueError("denominator must be tokens or documented")
    tree = small_tree(taxonomy)
    shared = reads.sparkSession.sparkContext.broadcast(tree)
    source = _per_read(mask_quality(reads, min_quality))
    kind = source.schema["read_id"].dataType
    rows = _chunk_rows(source, scheme, translated)
    if least_hash:
        rows = with_hash(rows, "minimizer").where(F.col("data").isNotNull() | unsigned_at_least("hash", least_hash)).drop("hash")
    found = rows.join(index.select("minimizer", F.col("taxon").cast("bigint").alias("taxon")), "minimizer", "left").where("data IS NOT NULL OR taxon IS NOT NULL")
    found = found.select("chunk", "slot", "taxon", "ids", "data").repartition("chunk").sortWithinPartitions("chunk", F.col("data").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packed, ids, held = None, None, None, []
        for b in batches:
            chunk = b.column(0).to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)] if len(chunk) else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                if chunk[x] != now:
                    if packed is not None:
                        yield answer(packed, ids, held)
                    now, held = chunk[x], []
                    # the packed row comes first
                    packed, ids = b.column(4)[x].as_py(), b.column(3)[x].values
                    x += 1
                part = b.slice(x, y - x)
                held.append((part.column(1).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)))
        if packed is not None:
            yield answer(packed, ids, held)

    def answer(data: bytes, ids: pa.Array, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        z = np.load(io.BytesIO(data))
        read, n, slot, lookup = z["read"], z["n"], z["slot"], z["lookup"]
        reads = len(ids)
        taxa = np.zeros(int(slot.max(initial=-1)) + 1, np.int64)
        for s, t in held:
            taxa[s] = t
        amb = slot < 0
        tax = np.where(amb, 0, taxa[np.maximum(slot, 0)]) if len(taxa) else np.zeros(len(slot), np.int64)
        hit = tax > 0
        count = lambda w, at: np.bincount(read[at], weights=None if w is None else w[at], minlength=reads).astype(np.int64)
        n_tokens, n_amb, group = count(n, slice(None)), count(n, amb), hit & lookup
        groups = count(None, group)
        mates = np.bincount(z["seq_read"], minlength=reads)
        counted = np.ones(len(read), bool)
        if quick == "compat" and len(read):
            # groups so far within the read; the run that brings enough, and all after it, are not counted
            so_far = np.cumsum(group)
            start = np.searchsorted(read, np.arange(reads))
            so_far = so_far - np.r_[0, so_far][start][read]
            stops = np.flatnonzero(hit & (so_far >= min_hit_groups))
            first = np.full(reads, len(read))
            np.minimum.at(first, read[stops], stops)
            counted = np.arange(len(read)) < first[read]
            hit = hit & counted
        total = count(n, counted) + (3 * mates if translated and compat else 0) - (count(n, amb & counted) if denominator == "documented" else 0)
        lengths = [[] for _ in range(reads)]
        for r, x in zip(z["seq_read"].tolist(), z["letters"].tolist()):
            lengths[r].append(str(x))
        # the taxon of the look-up that makes the wanted number of groups
        at = np.flatnonzero(group)
        nth = np.arange(len(at)) - np.searchsorted(read[at], read[at], "left") + 1
        deciding = at[nth == max(min_hit_groups, 1)]
        fast = np.zeros(reads, np.int64)
        fast[read[deciding]] = tax[deciding]
        same = np.r_[False, read[1:] == read[:-1]] if len(read) else np.zeros(0, bool)
        border = np.zeros(len(read), np.int8)
        if len(read):
            mate, frame = (np.r_[False, z[c][1:] != z[c][:-1]] for c in ("mate", "frame"))
            border = np.where(same & mate, 1, np.where(same & frame, 2, 0)).astype(np.int8)
        texts = _hit_texts(read, border, np.where(amb, -1, tax), n, reads)
        out = [ids, pa.array(["|".join(x) for x in lengths], pa.string()), *[pa.array(x) for x in (n_tokens, n_amb, groups, total)], pa.array(fast, mask=fast == 0), pa.array(texts, pa.string())]
        tree: Tree | None = shared.value
        if tree is None:
            order = np.lexsort((tax, read))
            order = order[hit[order]]
            r, t = read[order], tax[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])]) if len(r) else order
            sums = np.add.reduceat(n[order], first) if len(r) else order
            lists = pa.StructArray.from_arrays([pa.array(t[first], pa.int64()), pa.array(sums, pa.int64())], ["taxon", "n"])
            offsets = np.searchsorted(r[first], np.arange(reads + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(offsets), lists)], [*names, "own"])
        node = tree.places(tax)
        hit &= node >= 0
        need = np.ceil(confidence * total).astype(np.int64)
        best, call, under = tree.vote(read[hit], node[hit], n[hit], need)
        ids_ = [pa.array(tree.ids(x), mask=x < 0) for x in (best, call)]
        return pa.RecordBatch.from_arrays([*out, *ids_, pa.array(under, mask=call < 0)], [*names, "candidate", "call", "clade_hits"])

    names = ["read_id", "length", "n_tokens", "n_ambiguous", "hit_groups", "total", "quick", "text"]
    fields = f"read_id {kind.simpleString()}, {_COUNTS}"
    if tree is not None:
        d = found.mapInArrow(run, f"{fields}, candidate bigint, call bigint, clade_hits bigint")
    else:
        d = found.mapInArrow(run, f"{fields}, own array<struct<taxon:bigint,n:bigint>>")
        paths = taxonomy.select(F.col("tax_id").cast("bigint").alias("taxon"), F.col("path").cast("array<bigint>").alias("path"))
        hits = d.select("read_id", F.explode("own").alias("o")).select("read_id", "o.taxon", "o.n").join(paths, "taxon")
        hits = hits.groupBy("read_id").agg(F.collect_list(F.struct("taxon", "n", "path")).alias("hits"))
        d = d.drop("own").join(hits, "read_id", "left")
        d = resolve(d.withColumn("hits", F.coalesce("hits", F.array().cast(d.schema["hits"].dataType))), "hits", "total", confidence)
    text = F.col("text")
    if quick:
        enough = F.col("hit_groups") >= min_hit_groups
        d = d.withColumn("call", F.when(enough, F.col("call")) if quick == "compat" else F.col("quick"))
        text = F.when(F.col("call").isNotNull(), F.concat(F.col("call").cast("string"), F.lit(":Q"))).otherwise(text)
    else:
        d = d.withColumn("call", F.when(F.col("hit_groups") >= min_hit_groups, F.col("call")))
    return d.select("read_id", F.when(F.col("call").isNotNull(), "C").otherwise("U").alias("status"), F.col("call").alias("taxon"), "length", "n_tokens", "n_ambiguous", "hit_groups", "candidate", "clade_hits", text.alias("hits"))


def output_lines(calls: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """``read_id, line``: the five tab-separated fields; with a taxonomy the taxon is "name (taxid N)"."""
    tax = F.coalesce(F.col("taxon").cast("string"), F.lit("0"))
    if taxonomy is not None:
        calls = calls.join(taxonomy.select(F.col("tax_id").alias("taxon"), "name"), "taxon", "left")
        tax = F.format_string("%s (taxid %s)", F.coalesce("name", F.lit("unclassified")), tax)
    return calls.select("read_id", F.concat_ws("\t", "status", "read_id", tax, "length", "hits").alias("line"))


def tagged_reads(reads: DataFrame, calls: DataFrame, classified: bool) -> DataFrame:
    """The (un)classified reads, their header followed by ``kraken:taxid|N`` where classified."""
    if classified:
        hit = reads.join(calls.where("status = 'C'").select("read_id", "taxon"), "read_id")
        return hit.withColumn("header", F.concat_ws(" ", "read_id", F.concat(F.lit("kraken:taxid|"), F.col("taxon").cast("string"))))
    return reads.join(calls.where("status = 'C'").select("read_id"), "read_id", "left_anti").withColumn("header", F.col("read_id").cast("string"))


def record_text(reads: DataFrame) -> Column:
    """FASTA or, where there is a quality, FASTQ text of ``header, seq[, qual]``."""
    plain = F.concat(F.lit(">"), "header", F.lit("\n"), F.coalesce("seq", F.lit("")))
    if "qual" not in reads.columns:
        return plain
    full = F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    return F.when(F.col("qual").isNull(), plain).otherwise(full)


def sequence_outputs(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """``read_id, mate, status, text`` of every record: its own header (of classified ones followed by
    ``kraken:taxid|N``), sequence and quality. Mates keep their numbers, so that each can have its file.

    ``reads`` is ``read_id, mate, header, seq[, qual]``.
    """
    j = reads.join(calls.select("read_id", "status", "taxon"), "read_id")
    tag = F.when(F.col("status") == "C", F.concat(F.lit("kraken:taxid|"), F.col("taxon").cast("string")))
    j = j.withColumn("header", F.concat_ws(" ", "header", tag))
    return j.select("read_id", "mate", "status", record_text(j).alias("text"))


def write_sequence_outputs(outputs: DataFrame, path: str) -> None:
    """One folder per status and mate (``status=C/mate=1`` and so on), records in the order of their read ids."""
    outputs.orderBy("read_id").select("status", "mate", F.col("text").alias("value")).write.mode("overwrite").partitionBy("status", "mate").text(path)


def probe(runs: DataFrame, index: DataFrame) -> DataFrame:
    """``read_id, n_minimizers, n_known``: distinct minimizers of each read, and those that the index has."""
    own = runs.where("minimizer IS NOT NULL").select("read_id", "minimizer").distinct()
    known = index.select("minimizer").withColumn("known", F.lit(1))
    return own.join(known, "minimizer", "left").groupBy("read_id").agg(F.count("*").alias("n_minimizers"), F.count("known").alias("n_known"))


def run_statistics(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: reads, letters, classified reads and their percentage."""
    n = calls.agg(F.count("*").alias("n_reads"), F.sum(F.when(F.col("status") == "C", 1).otherwise(0)).cast("bigint").alias("n_classified"))
    letters = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n_letters"))
    share = F.round(F.when(F.col("n_reads") > 0, 100.0 * F.col("n_classified") / F.col("n_reads")).otherwise(0.0), 2)
    return n.join(letters).select("n_reads", "n_letters", "n_classified", share.alias("pct_classified"))
