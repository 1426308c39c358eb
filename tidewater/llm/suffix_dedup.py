"""Removal of byte strings that occur twice, by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
too, in any document or in the same one.  Strings are judged on the input.

1. *Anchors.*  A string of ``length`` bytes holds grams of half that length; the
   first gram with the least hash is its anchor.  The choice depends on the string's bytes
   alone, so equal strings have their anchors at the same place: only suffixes
   that start at anchors have to be sorted, about one in a hundred.  An anchor
   serves a run of neighbouring strings, its *windows*; the bytes that they cover are its context.
2. *Candidates.*  Anchors are counted by the hash of their gram.  One that occurs once has no repeated
   window.  One whose contexts are all equal has repeated windows only.  The others are sorted.
3. *Sorting* (:func:`deep_shallow`).  Contexts of equal grams meet in one task, equal ones once, with their
   number.  Their suffixes from the anchor on, and what lies before it read backwards, are
   sorted: multikey quicksort with characters of eight bytes down to ``SHALLOW`` bytes,
   then a blind trie for each group that still has a common prefix.
   Both orders come with the common prefixes of neighbours, so that for each
   distance between a window's start and its anchor the windows equal on both
   sides are found by one counting pass.
4. *Hot grams.*  More than ``HOT`` different contexts of one gram do not meet in
   one task: each is cut into blocks of windows, the blocks are counted by the
   hash of the bytes that all their windows share, and blocks that are still
   mixed are cut into single windows (:func:`_refine`).  Nothing is dropped.
5. *Removal.*  The spans of a document meet its text once more.

Shuffled are about 40 bytes for each anchor (an anchor in a hundred bytes), the
texts for the two joins, and the contexts that have to be sorted.  A document
is read in pieces of ``PIECE`` bytes that overlap, so long texts need no more memory for
anchors; the last step holds one whole text.

Defined cases: NULL and empty texts have no bytes (digest of nothing); a text
shorter than ``length`` keeps everything; repeated rows, with or without the
same doc_id, are documents each and lose what they share; matches never cross
documents.  Only ``doc_id`` and ``text`` are read besides ``keep``, so further columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import common as C
from tidewater.session import materialize

#: bytes of a string that may not occur twice
LENGTH = 400
#: bytes handled at a time when anchors are chosen
PIECE = 1 << 21
#: bytes sorted by multikey quicksort before the tries
SHALLOW = 32
#: different contexts of one gram that are sorted in one task
HOT = 20_000
#: windows in a block of a hot gram's context
BLOCK = 16
#: bytes of contexts sorted at a time
BATCH = 32 << 20
_U = np.uint64
_PLACE = _U((1 << 22) - 1)


# -- 1. anchors ------------------------------------------------------------------------------------


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step, low = 1, keys
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:len(keys) - width + 1], low[width - step:]) if step < width else low


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int):
    """Anchors of the texts ``data[begin:end]`` (each of ``length`` bytes at least, one after the other):
    (text, place, first and last window, gram hash)."""
    gram = length // 2
    up, down = C._powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=total[1:])
    grams = C.mix((total[gram:] - total[:-gram]) * down[:len(data) - gram + 1])
    place = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=_U), length - gram + 1) & _PLACE
    edge = np.zeros(len(place) + 1, dtype=np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0  # windows that lie within one text
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    new[begin] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(begin, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(place)) - 1, (end - length)[text])
    at = place[first].astype(np.int64)
    return text, at, first, last, grams[at]


def _anchor_rows(length: int, piece_bytes: int = PIECE):
    import xxhash

    def pieces(column):
        """(row, offset in the text, bytes) of windows to be looked at together."""
        if not len(column):
            return
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
            at = offsets[row]
            while offsets[row + 1] - at >= length:
                yield row, at - offsets[row], data[at:min(at + piece_bytes, offsets[row + 1])]
                at += piece_bytes - length + 1

    def chunk(held):
        data = np.concatenate([p for _, _, p in held])
        size = np.array([len(p) for _, _, p in held])
        end = np.cumsum(size)
        text, at, first, last, gram = anchors(data, end - size, end, length)
        view = memoryview(data)
        digest = xxhash.xxh3_64_intdigest
        seen = np.fromiter((digest(view[s:e]) for s, e in zip(first, last + length)), dtype=_U, count=len(first))
        nearest = at - last
        context = seen ^ C.mix(nearest.astype(_U))
        # neighbouring anchors with the same context (short periods) are one row
        new = np.ones(len(at), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) > length)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        shift = np.array([o for _, o, _ in held]) - (end - size)
        rows = np.array([r for r, _, _ in held])
        return rows[text[head]], [(at + shift[text])[head], nearest[head], (at - first)[head], gram[head].astype(np.int64),
                                  context[head].astype(np.int64), tail - head + 1, at[tail] - at[head]]

    def run(batches):
        names = ["k1", "k2", "at", "near", "far", "gram", "context", "n", "reach"]
        for batch in batches:
            held, size = [], 0

            def flush():
                rows, columns = chunk(held)
                pick = pa.array(rows)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(c.astype(np.int64)) for c in columns)], names=names)
            for piece in pieces(batch.column(2)):
                if held and size + len(piece[2]) > piece_bytes:
                    yield flush()
                    held, size = [], 0
                held.append(piece)
                size += len(piece[2])
            if held:
                yield flush()
    return run


_ANCHOR = ", ".join(f"{c} long" for c in ("k1", "k2", "at", "near", "far", "gram", "context", "n", "reach"))


# -- 3. sorting ------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """``members`` in the order of their strings, and the common prefix of each with the one before it.

    A node is [depth, {byte at that depth: node or leaf}]; a leaf is the list of equal strings.  A
    descent looks only at the bytes where nodes branch; one comparison with the leaf it ends at tells where the string parts.
    """
    root = [members[0]]
    for m in members[1:]:
        s = strings[m]
        node = root
        while isinstance(node[-1], dict):
            d, kids = node
            node = kids.get(s[d] if d < len(s) else -1) or next(iter(kids.values()))
        t = strings[node[0]]
        depth = _common(s, t)
        if depth == len(s) == len(t):
            node.append(m)
            continue
        up, node = None, root
        while isinstance(node[-1], dict) and node[0] < depth:
            up, node = node, node[1][s[node[0]] if node[0] < len(s) else -1]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][mine] = [m]
            continue
        fork = [depth, {mine: [m], t[depth] if depth < len(t) else -1: node}]
        if up is None:
            root = fork
        else:
            up[1][s[up[0]] if up[0] < len(s) else -1] = fork
    order, prefix, stack = [], [], [(root, -1)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node[-1], dict):
            d, kids = node
            keys = sorted(kids)
            stack.extend((kids[k], d) for k in reversed(keys[1:]))
            stack.append((kids[keys[0]], shared))
        else:
            order += node
            prefix += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, prefix


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings, common prefix of each with the one before it; -1 for the first)."""
    n = len(strings)
    words = shallow // 8
    size = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    heads = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), dtype=">u8").reshape(n, words).astype(_U)
    order, prefix = np.arange(n), np.full(n, -1, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64)  # by place in the order
    open_ = np.arange(n)  # places in groups of two or more
    for w in range(words):  # three-way splits of all groups at once, one character of eight bytes at a time
        if not len(open_):
            break
        key, g = heads[order[open_], w], group[open_]
        by = np.lexsort((key, g))
        order[open_], key = order[open_[by]], key[by]
        diff = key[1:] ^ key[:-1]
        split = (g[1:] == g[:-1]) & (diff != 0)
        same_bytes = sum((diff >> _U(56 - 8 * k) == 0).astype(np.int64) for k in range(7))
        at = open_[1:][split]
        prefix[at] = 8 * w + same_bytes[split]
        group[open_] = np.cumsum(np.concatenate(([0], (g[1:] != g[:-1]) | split)))
        g = group[open_]
        alone = np.ones(len(g), dtype=bool)
        alone[1:] &= g[1:] != g[:-1]
        alone[:-1] &= g[1:] != g[:-1]
        group[open_] += n * (w + 1)  # never mixed up with groups closed before
        open_ = open_[~alone]
    if len(open_):
        g = group[open_]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        for s, e in zip(starts, np.append(starts[1:], len(g))):
            at = open_[s:e]
            found, shared = blind_trie(strings, order[at].tolist())
            order[at] = found
            prefix[at[1:]] = shared[1:]
    # padding is no text
    before = np.minimum(size[order][1:], size[order][:-1])
    prefix[1:] = np.minimum(prefix[1:], before)
    return order, prefix


def repeated_windows(contexts: list[bytes], near: np.ndarray, far: np.ndarray, count: np.ndarray, length: int):
    """(context, nearest, farthest) runs of windows that occur in another context too, for contexts with ``count`` 1.

    A window starts ``o`` bytes before its anchor, ``near <= o <= far``; a context starts at its first window.
    """
    n = len(contexts)
    right = [c[f:] for c, f in zip(contexts, far)]
    left = [c[:f][::-1] for c, f in zip(contexts, far)]
    (order_r, lcp_r), (order_l, lcp_l) = deep_shallow(right), deep_shallow(left)
    class_r, class_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    one, base, hits = count == 1, length + 1, [np.zeros(0, dtype=np.int64)]
    for o in range(int(near.min()), int(far.max()) + 1):
        on = np.flatnonzero((near <= o) & (o <= far))
        class_r[order_r] = np.cumsum(lcp_r < length - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        _, back, many = np.unique(class_r[on] * (n + 1) + class_l[on], return_inverse=True, return_counts=True)
        hits.append(on[(many[back] > 1) & one[on]] * base + o)
    hit = np.sort(np.concatenate(hits))
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(hit)), dtype=bool), np.diff(hit) != 1)))
    last = hit[np.append(edge[1:], len(hit)) - 1] if len(hit) else hit
    return np.stack((hit[edge] // base, hit[edge] % base, last % base))


def _sort_rows(length: int):
    """Batches of contexts sorted by gram -> spans of repeated windows."""
    def run(batches):
        def solve(held):
            t = pa.Table.from_batches(held)
            near, far, n, at = (t.column(c).to_numpy() for c in ("near", "far", "n", "at"))
            who, first, last = repeated_windows(t.column("bytes").to_pylist(), near, far, n, length)
            pick = pa.array(who)
            return pa.RecordBatch.from_arrays([t.column("k1").combine_chunks().take(pick), t.column("k2").combine_chunks().take(pick),
                                               pa.array(at[who] - last), pa.array(at[who] - first + length)], names=["k1", "k2", "low", "high"])

        held, size = [], 0
        for batch in batches:
            gram = batch.column(batch.schema.get_field_index("gram")).to_numpy()
            begin = 0
            if held:  # the last gram of the batch before may go on
                before = held[-1].column("gram")[-1].as_py()
                begin = int(np.searchsorted(gram != before, True)) if (gram != before).any() else len(gram)
                held.append(batch.slice(0, begin))
                size += batch.slice(0, begin).nbytes
                held = [b for b in held if b.num_rows]
            while begin < len(gram):
                if held and size >= BATCH:
                    yield solve(held)
                    held, size = [], 0
                part = batch.slice(begin)
                each = part.nbytes / max(1, part.num_rows)
                to = min(len(gram), begin + max(1, int((BATCH - size) / max(each, 1))))
                while to < len(gram) and gram[to] == gram[to - 1]:  # whole groups only
                    to += 1
                held.append(batch.slice(begin, to - begin))
                size += int(each * (to - begin))
                begin = to
        if held:
            yield solve(held)
    return run


# -- 4. hot grams ----------------------------------------------------------------------------------


def _block_rows(length: int, width: int):
    """Contexts -> blocks of ``width`` windows with the hash of what all of them share and of all that they cover.

    A block at a context's end may lack windows; what is shared is then still that of the whole block.
    """
    import xxhash

    def run(batches):
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, out = [], []
            far, low, high = (batch.column(c).to_numpy() for c in ("far", "low", "high"))
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                view = memoryview(text)
                at = int(far[i])  # the anchor's place in the context
                for o in range(int(low[i]) // width * width, int(high[i]) + 1, width):
                    a, b = max(o, int(low[i])), min(o + width - 1, int(high[i]))
                    core, cover = view[at - o:at - o - width + 1 + length], view[at - b:at - a + length]
                    rows.append(i)
                    out.append((h(core, seed=o), h(cover, seed=a), a, b))
            if rows:
                pick, cols = pa.array(rows), np.array(out, dtype=_U).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pick) for c in ("k1", "k2", "at", "far", "n")] + [pa.array(c.astype(np.int64)) for c in cols],
                    names=["k1", "k2", "at", "far", "n", "core", "cover", "low", "high"])
    return run


def _refine(hot: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of contexts that are too many to be sorted in one task.

    Equal windows lie in blocks with the same core.  Blocks whose core occurs once have none, blocks
    with one core and one cover nothing else; what is left is cut into single windows.
    """
    place = ["k1", "k2", "at", "far", "n"]
    part = hot.select(*place, "bytes", F.col("near").alias("low"), F.col("far").alias("high"))
    schema = "k1 long, k2 long, at long, far long, n long, core long, cover long, low long, high long"
    spans = []
    for width in (BLOCK, 1):
        blocks = materialize(part.mapInArrow(_block_rows(length, width), schema), f"repeat-blocks-{width}")
        many = (blocks.groupBy("core").agg(F.sum("n").alias("_n"), F.min("cover").alias("_a"), F.max("cover").alias("_b"))
                .where(F.col("_n") > 1).select("core", (F.col("_a") == F.col("_b")).alias("_pure")))
        met = blocks.where(F.col("n") == 1).join(many, "core")  # contexts that occur twice have gone already
        spans.append(met.where("_pure").select("k1", "k2", (F.col("at") - F.col("high")).alias("low"), (F.col("at") - F.col("low") + length).alias("high")))
        if width > 1:
            left = blocks.join(many.where(~F.col("_pure")), "core").select("k1", "k2", "at", "low", "high")
            part = hot.select(*place, "bytes").join(left, ["k1", "k2", "at"]).select(*place, "bytes", "low", "high")
    return spans[0].unionByName(spans[1])


# -- the operator ----------------------------------------------------------------------------------


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Rows with a 128-bit key of (doc_id, text): equal rows have equal spans."""
    return docs.select(*more, F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """(k1, k2, low, high): byte runs of repeated strings; they may overlap and come several times."""
    keyed = _keyed(docs)
    found = materialize(keyed.mapInArrow(_anchor_rows(length, piece), _ANCHOR), "anchors")
    grams = (found.groupBy("gram").agg(F.sum("n").alias("_n"), F.min("context").alias("_a"), F.max("context").alias("_b"))
             .where(F.col("_n") > 1).select("gram", (F.col("_a") != F.col("_b")).alias("mixed")))
    again = materialize(found.join(grams, "gram"), "repeated-anchors")
    mixed = again.where("mixed")
    whole = [(F.col("at") - F.col("far")).alias("low"), (F.col("at") + F.col("reach") - F.col("near") + length).alias("high")]
    pure = again.where(~F.col("mixed")).select("k1", "k2", *whole)
    # different contexts of a gram, one place of each
    where = ["k1", "k2", "at", "near", "far"]
    classes = materialize(mixed.groupBy("gram", "context").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in where]), "contexts")
    copies = mixed.join(classes.where(F.col("n") > 1).select("gram", "context"), ["gram", "context"], "left_semi").select("k1", "k2", *whole)
    places = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "near", "far", "gram", "n")).alias("places"))

    def cut(batches):
        names = ["k1", "k2", "gram", "at", "near", "far", "n", "bytes"]
        for batch in batches:
            rows, out, size = [], [], 0

            def flush():
                pick = pa.array(rows)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array([r[c] for r in out]) for c in ("gram", "at", "near", "far", "n")),
                                                   pa.array([r["bytes"] for r in out], pa.binary())], names=names)
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer()
                view = memoryview(raw)
                for r in batch.column(3)[i].as_py():
                    rows.append(i)
                    r["bytes"] = bytes(view[r["at"] - r["far"]:r["at"] - r["near"] + length])
                    out.append(r)
                    size += len(r["bytes"])
                    if size > BATCH // 4:
                        yield flush()
                        rows, out, size = [], [], 0
            if rows:
                yield flush()

    joined = keyed.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places")
    segments = joined.mapInArrow(cut, "k1 long, k2 long, gram long, at long, near long, far long, n long, bytes binary")
    too_many = materialize(classes.groupBy("gram").agg(F.count("*").alias("_k")).where(F.col("_k") > hot).select("gram"), "hot-grams")
    parts = [pure, copies]
    if too_many.isEmpty():
        cold = segments
    else:
        segments = materialize(segments, "contexts-cut")
        cold = segments.join(too_many, "gram", "left_anti")
        parts.append(_refine(segments.join(too_many, "gram", "left_semi"), length))
    cold = cold.repartition("gram").sortWithinPartitions("gram")
    parts.append(cold.mapInArrow(_sort_rows(length), "k1 long, k2 long, low long, high long"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    return spans


def merge_spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given ones."""
    by = np.argsort(low, kind="stable")
    low, reach = low[by], np.maximum.accumulate(high[by])
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    return low[new], reach[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, hot: int = HOT,
                   piece: int = PIECE) -> DataFrame:
    """``keep`` columns of each row, n_bytes, spans (removed runs of bytes: low, high) and kept (the bytes that stay)."""
    if length < 16:
        raise ValueError("length must be 16 at least")
    keep = keep or ["doc_id"]
    spans = (repeated_spans(docs, length, hot, piece).distinct().groupBy("k1", "k2")
             .agg(F.collect_list("low").alias("__low"), F.collect_list("high").alias("__high")))
    carried = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(*carried, F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), "text")
    rows = rows.join(spans, ["k1", "k2"], "left").select(*[f"__keep{i}" for i in range(len(keep))], "text", "__low", "__high")
    span = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts, lows, highs = (batch.column(len(keep) + k) for k in range(3))
            size, runs, kept, held, start = [], [], [], 0, 0

            def flush(to):
                ids = [batch.column(i).slice(start, to - start) for i in range(len(keep))]
                return pa.RecordBatch.from_arrays([*ids, pa.array(size, pa.int64()), pa.array(runs, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                                                   pa.array(kept, pa.binary())], names=schema.names)
            for i in range(batch.num_rows):
                raw = b"" if not texts[i].is_valid else texts[i].as_buffer().to_pybytes()
                size.append(len(raw))
                if lows[i].is_valid:
                    low, high = merge_spans(np.array(lows[i].as_py()), np.array(highs[i].as_py()))
                    runs.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist())])
                    kept.append(b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)])))
                else:
                    runs.append([])
                    kept.append(raw)
                held += len(raw)
                if held > BATCH:
                    yield flush(i + 1)
                    size, runs, kept, held, start = [], [], [], 0, i + 1
            if start < batch.num_rows:
                yield flush(batch.num_rows)

    return rows.mapInArrow(run, schema)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when strings of 400 bytes that occur twice are removed."""
    out = remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
