"""LM scoring: a Brown class bigram model, its classes found by exchange clustering.

P(w_i | w_{i-1}) = P(class of w_i | class of w_{i-1}) P(w_i | class of w_i). Counts cover all
training documents and every word takes part in the exchange. It starts on the driver with
the most frequent words (a fixed number, so its table is bounded), whose classes seed the
rest. Then rounds over the corpus sum, for each word, the classes before and after it, and
move the word to the class that raises the class bigram likelihood most. In a round only a
share of the words moves, so that words which stand side by side don't move past each other.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, default_parts, free_shuffles, in_fold, stored

#: Words that seed the classes, classes, and sweeps of the first exchange over all its words.
SEED_WORDS, CLASSES, SWEEPS = 1500, 48, 6
#: Shares of the words, moved one a round after the round that places all words.
SHARES = 2
#: Class tables have a slot for each hash of so many bits; words that share a slot share a class.
LEAST_BITS, MOST_BITS = 16, 24
#: Bytes of text in a block, whose words are listed once.
BLOCK_BYTES = 16 << 20
#: Words of a block whose neighbours are counted at once, in a dense table.
COUNTED = 32_768
#: Slots in a row of a class table.
CHUNK = 4096
#: Bits of the place of a class before or after in a packed count; the count has the others.
STATE_BITS = 16
#: Additive smoothing of class transitions, and of words in a class.
TRANSITION, EMISSION = 0.1, 0.5
#: The end of a text: its word, its class (after the others) and the first state of each text.
END = b""
#: Class of a slot that no training word has, or none whose neighbours have classes.
NO_CLASS = 255


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased."""
    return text.lower().split() if text else []


def exchange(counts: np.ndarray, classes: int, rounds: int = SWEEPS) -> np.ndarray:
    """Classes of words by the exchange algorithm on their bigram ``counts``.

    Words start in classes by frequency rank. In each round every word, in the order of
    frequency, moves to the class that raises the class bigram likelihood
    sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d) the most.
    """
    v = len(counts)
    classes = min(classes, max(1, v))
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    of = np.empty(v, np.int64)
    of[order] = np.arange(v) % classes
    member = np.zeros((v, classes))
    member[np.arange(v), of] = 1
    left, right = counts @ member, counts.T @ member  # by word: counts with the class after, before
    table = member.T @ left
    own = np.diag(counts)

    def x(a):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-300)), 0.0)

    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            c = of[w]
            after, before = left[w].copy(), right[w].copy()
            after[c] -= own[w]
            before[c] -= own[w]
            table[c] -= after
            table[:, c] -= before
            table[c, c] -= own[w]
            rows, cols = table.sum(1), table.sum(0)
            # gain of joining d: rows d and columns d of the table grow by the word's counts
            gain = (x(table + after) - x(table)).sum(1) + (x(table.T + before) - x(table.T)).sum(1)
            diagonal = np.diag(table)
            gain += x(diagonal + after + before + own[w]) - x(diagonal + after) - x(diagonal + before) + x(diagonal)
            out, into = after.sum() + own[w], before.sum() + own[w]
            gain -= x(rows + out) - x(rows) + x(cols + into) - x(cols)
            d = int(np.argmax(np.round(gain, 9)))
            if gain[d] <= gain[c] + 1e-9:
                d = c
            table[d] += after
            table[:, d] += before
            table[d, d] += own[w]
            if d != c:
                moved += 1
                of[w] = d
                seen = counts[:, w]
                left[:, c] -= seen
                left[:, d] += seen
                seen = counts[w]
                right[:, c] -= seen
                right[:, d] += seen
        if not moved:
            break
    return of


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF


def _planes(codes: np.ndarray, words: int) -> bytes:
    """``codes`` below ``words`` by byte, all lowest bytes first: the higher ones are mostly equal and compress."""
    width = max(1, ((words - 1).bit_length() + 7) // 8)
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _codes(planes, words: int) -> np.ndarray:
    """The codes that ``_planes`` wrote."""
    width = max(1, ((words - 1).bit_length() + 7) // 8)
    parts = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = parts[0].astype(np.uint32)
    for place in range(1, width):
        out |= parts[place].astype(np.uint32) << np.uint32(8 * place)
    return out


def coded_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, held_out, sizes, words, counts, hashes, codes): blocks of neighbouring ``docs(doc_id, held_out, text)``.

    A block holds whole texts of about ``block_bytes`` together, a longer text alone. It lists
    its distinct words with their counts in its training documents; ``codes`` are the places
    of all tokens in that list by byte, an end token after each text.
    """

    def block(name, rows):
        sizes = np.fromiter((len(ws) for _, _, ws in rows), np.int64, len(rows))
        flat = pa.concat_arrays([ws for _, _, ws in rows]).dictionary_encode()
        code, words = flat.indices.to_numpy(), flat.dictionary
        held = np.array([h for _, h, _ in rows], bool)
        count = np.bincount(code[~np.repeat(held, sizes)], minlength=len(words))
        hashes = np.fromiter(map(_hash, words.to_pylist()), np.uint32, len(words))
        one = {
            "block": pa.array([name], pa.int64()), "doc_id": pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())), "held_out": pa.array([held.tolist()], pa.list_(pa.bool_())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": pa.ListArray.from_arrays([0, len(words)], words), "counts": pa.array([count], pa.list_(pa.int32())),
            "hashes": pa.array([hashes.tobytes()], pa.binary()), "codes": pa.array([_planes(code, len(words))], pa.binary()),
        }
        return pa.record_batch(list(one.values()), names=list(one))

    def run(batches):
        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in byte_slices(batches, "text", block_bytes):
            texts = (pa.array([*tokens(t.as_py()), END], pa.binary()) for t in batch.column("text").cast(pa.binary()))  # Python's words of one text at once
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out")), texts, strict=True))
            own = batch.column("text").nbytes
            if held and size + own > block_bytes:
                yield block(first + made, held)
                made, held, size = made + 1, [], 0
            held, size = held + rows, size + own
        if held:
            yield block(first + made, held)

    spec = "block long, doc_id array<long>, held_out array<boolean>, sizes array<long>, words array<binary>, counts array<int>, hashes binary, codes binary"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, spec)


def _tokens_of(batches):
    """For each block its (hashes by word, codes, sizes, held out by text)."""
    for batch in batches:
        for row in range(batch.num_rows):
            hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint32)
            codes = _codes(batch.column("codes")[row].as_buffer(), len(hashes))
            yield hashes, codes, batch.column("sizes")[row].values.to_numpy(), batch.column("held_out")[row].values.to_numpy(zero_copy_only=False).astype(bool)


def _training_only(codes, sizes, held):
    """Codes and text ends of the training texts of a block."""
    keep = ~np.repeat(held, sizes)
    return codes[keep], np.cumsum(sizes[~held]) - 1


def _before(states: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The state before each token; ``start`` before the first of a text."""
    before = np.empty_like(states)
    before[1:] = states[:-1]
    before[:1] = start
    before[ends[:-1] + 1] = start
    return before


def _states(table: np.ndarray, hashes: np.ndarray, classes: int) -> np.ndarray:
    """State by word: its slot's class, or the last state where there is none."""
    state = table[hashes & np.uint32(len(table) - 1)].astype(np.int64)
    state[state == NO_CLASS] = classes + 1
    state[hashes == _hash(END)] = classes
    return state


def seed_classes(blocks: DataFrame, seeds: list[bytes], bits: int, classes: int) -> np.ndarray:
    """The class table after the exchange over the seed words' slots alone, by their bigrams in the training documents."""
    table = np.full(1 << bits, NO_CLASS, np.uint8)
    slots = np.unique(np.array([_hash(w) & (1 << bits) - 1 for w in seeds if w != END], np.int64))
    size = len(slots)
    if not size:
        return table

    def pairs(batches):
        total = np.zeros(size * size, np.int64)
        for hashes, codes, sizes, held in _tokens_of(batches):
            codes, ends = _training_only(codes, sizes, held)
            slot = (hashes & np.uint32((1 << bits) - 1)).astype(np.int64)
            at = np.minimum(np.searchsorted(slots, slot), size - 1)
            place = np.where((slots[at] == slot) & (hashes != _hash(END)), at, -1)[codes]
            before = _before(place, ends, -1)
            both = (before >= 0) & (place >= 0)
            total += np.bincount(before[both] * size + place[both], minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["k", "c"])

    found = blocks.select("hashes", "codes", "sizes", "held_out").mapInArrow(pairs, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()  # at most size * size rows
    counts = np.zeros((size, size))
    counts[found["k"] // size, found["k"] % size] = found["c"]
    table[slots] = exchange(counts, classes)
    return table


def transitions(blocks: DataFrame, table: np.ndarray, classes: int) -> np.ndarray:
    """Counts of (state before, state) over the training documents."""
    states = classes + 2

    def count(batches):
        total = np.zeros(states * states, np.int64)
        for hashes, codes, sizes, held in _tokens_of(batches):
            codes, ends = _training_only(codes, sizes, held)
            state = _states(table, hashes, classes)[codes]
            total += np.bincount(_before(state, ends, classes) * states + state, minlength=states * states)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["k", "c"])

    out = np.zeros(states * states)
    for r in blocks.select("hashes", "codes", "sizes", "held_out").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[r.k] = r.c
    return out.reshape(states, states)


def exchange_round(blocks: DataFrame, table: np.ndarray, share: int | None, classes: int, parts: int) -> np.ndarray:
    """``table`` after a round in which the slots of a ``share`` (of ``SHARES``; None: those without a class) move.

    A task lists, for each slot of a block, how often each class stands before and after it.
    Lists are summed over the corpus by slot. A slot goes to the class d that raises
    sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d) the most, to first order in
    the slot's counts: it has a small part of its class's. The sums are whole numbers, so
    the classes depend on the table's rows and not on their layout.
    """
    seen = transitions(blocks, table, classes)[: classes + 1, : classes + 1] + TRANSITION
    after = np.log(seen / seen.sum(1, keepdims=True))[:classes]  # P(class after | d)
    before = np.log(seen / seen.sum(0, keepdims=True))[:, :classes]  # P(class before | d)
    gains = np.concatenate([before, after.T])
    cells, width, mask = classes + 1, 2 * (classes + 1), len(table) - 1

    def emit(batches):
        for hashes, codes, sizes, held in _tokens_of(batches):
            codes, ends = _training_only(codes, sizes, held)
            codes = codes.astype(np.int64)
            of = _states(table, hashes, classes)
            slot = (hashes & np.uint32(mask)).astype(np.int64)
            moves = (table[slot] == NO_CLASS) if share is None else (slot >> 4) % SHARES == share
            moves &= hashes != _hash(END)
            local = np.cumsum(moves) - 1
            names = slot[moves]
            state = of[codes]
            own = np.flatnonzero(moves[codes])
            if not len(own):
                continue
            left, right = _before(state, ends, classes)[own], state[own + 1]  # a word is never the last token
            keys = np.concatenate([local[codes[own]] * width + left, local[codes[own]] * width + cells + right])
            keys = keys[np.concatenate([left, right]) <= classes]  # neighbours without a class tell nothing
            for low in range(0, len(names), COUNTED):  # a dense table of these words alone
                high = min(len(names), low + COUNTED)
                total = np.bincount(keys[(keys >= low * width) & (keys < high * width)] - low * width, minlength=(high - low) * width)
                used = np.flatnonzero(total)
                cuts = np.searchsorted(used, np.arange(high - low + 1) * width)
                packed = (used % width) | total[used] << STATE_BITS
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(packed))
                rows = pa.record_batch([pa.array(names[low:high] // CHUNK, pa.int32()), pa.array(names[low:high], pa.int32()), lists], names=["chunk", "slot", "seen"])
                yield rows.filter(pa.array(np.diff(cuts) > 0))

    def decide(batches):
        here, sums = None, None
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if chunk[low] != here:
                    if here is not None:
                        yield settled(here, sums)
                    here, sums = chunk[low], np.zeros((CHUNK, width), np.int64)
                lists = batch.column("seen").slice(low, high - low)
                values = lists.flatten().to_numpy()
                row = np.repeat(batch.column("slot").to_numpy()[low:high] % CHUNK, np.diff(lists.offsets.to_numpy()))
                np.add.at(sums, (row, values & (1 << STATE_BITS) - 1), values >> STATE_BITS)
        if here is not None:
            yield settled(here, sums)

    def settled(chunk, sums):
        best = np.round(sums @ gains, 6).argmax(1)
        best[~sums.any(1)] = NO_CLASS
        return pa.record_batch([pa.array([chunk], pa.int32()), pa.array([best.astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "classes"])

    listed = blocks.select("hashes", "codes", "sizes", "held_out").mapInArrow(emit, "chunk int, slot int, seen array<long>")
    found = listed.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(decide, "chunk int, classes binary")
    out = table.copy()
    for r in found.toLocalIterator():  # at most a byte for each of the table's slots
        new = np.frombuffer(bytes(r.classes), np.uint8)
        new = new[: len(table)]
        part = out[r.chunk * CHUNK : r.chunk * CHUNK + len(new)]
        part[new != NO_CLASS] = new[new != NO_CLASS]
    return out


def fit_classes(blocks: DataFrame, totals: DataFrame, seeds: int = SEED_WORDS, classes: int = CLASSES) -> np.ndarray:
    """The class table of all training words; ``totals`` has (w, c).

    The table has a slot for four words or more, up to 2^``MOST_BITS`` slots; it is a byte a
    slot, which is what tasks and driver hold of it.
    """
    parts = default_parts(blocks.sparkSession)
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * totals.count()).bit_length()))
    words = [bytes(r.w) for r in totals.orderBy(F.desc("c"), "w").limit(seeds).collect()]
    table = seed_classes(blocks, words, bits, classes)
    for share in (None, *range(SHARES)):
        table = exchange_round(blocks, table, share, classes, parts)
        gc.collect()  # the round's frames, whose shuffles can then go
        free_shuffles(blocks.sparkSession)
    return table


def repeated_slots(totals: DataFrame, slots: int) -> np.ndarray:
    """Whether a word of each of ``slots`` (a power of two) is listed by more than one block and has training tokens; ``totals`` has (w, c, n).

    It is collected as bitmaps, a bit a slot.
    """

    def place(batches):
        for batch in batches:
            hashes = np.fromiter(map(_hash, batch.column("w").to_pylist()), np.int64, batch.num_rows)
            yield pa.record_batch([pa.array(np.unique(hashes & slots - 1) + 1)], names=["p"])

    out = np.zeros(slots, bool)
    placed = totals.where("n > 1 and c > 0").select("w").mapInArrow(place, "p long")
    for r in placed.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toLocalIterator():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        first = (r.b - 1) * len(bits)
        out[first : first + len(bits)] = bits[: slots - first]
    return out


def listed_words(blocks: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(home, i, w, own): the words of each block whose slot is ``repeated``, and their counts there."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint32)
                at = np.flatnonzero(repeated[hashes & np.uint32(len(repeated) - 1)])
                words, counts = batch.column("words")[row].values.take(pa.array(at)), batch.column("counts")[row].values.to_numpy()[at]
                for low in range(0, len(at), 100_000):
                    part = slice(low, low + 100_000)
                    home = pa.array(np.full(len(at[part]), batch.column("block")[row].as_py(), np.int64))
                    yield pa.record_batch([home, pa.array(at[part].astype(np.int32)), words[part], pa.array(counts[part])], names=["home", "i", "w", "own"])

    return blocks.select("block", "words", "counts", "hashes").mapInArrow(run, "home long, i int, w binary, own int")


def _by_state(totals: DataFrame, table: np.ndarray, classes: int) -> tuple[np.ndarray, int]:
    """(distinct words by state, all tokens) of the training documents."""

    def count(batches):
        words, total = np.zeros(classes + 2, np.int64), 0
        for batch in batches:
            hashes = np.fromiter(map(_hash, batch.column("w").to_pylist()), np.uint32, batch.num_rows)
            words += np.bincount(_states(table, hashes, classes), minlength=classes + 2)
            total += int(batch.column("c").to_numpy().sum())
        yield pa.record_batch([pa.array(np.arange(classes + 3)), pa.array([*words.tolist(), total], pa.int64())], names=["s", "v"])

    out = np.zeros(classes + 3, np.int64)
    for r in totals.mapInArrow(count, "s long, v long").groupBy("s").agg(F.sum("v").alias("v")).collect():
        out[r.s] = r.v
    return out[:-1].astype(float), int(out[-1])


def score_documents(docs: DataFrame, seeds: int = SEED_WORDS, classes: int = CLASSES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs(doc_id, text, held_out)``.

    The corpus is written once as blocks of coded texts with their lists of words. A row
    for each word of a block, not one for each token, is counted. A word that one block alone
    lists has its count there; the others meet their counts in the corpus, and those which
    differ from the block's go back to it, so no task holds more than a block and its words.
    Rounds of the exchange read the codes alone.

    Unknown words, and known ones that never had a neighbour with a class, share the last state.
    Probabilities are smoothed, so each text has a finite score. A null text is empty: one
    end token. A null id is returned as null; repeated rows are documents of their own;
    other columns are ignored; an empty table gives no rows. A very long text is a block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stored(coded_blocks(rows, block_bytes), "brown-blocks")
    listed = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("w"), F.col("x.counts").alias("c"))
    every = stored(listed.groupBy("w").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where("c > 0"), "brown-words")
    totals = every.select("w", "c")
    free_shuffles(docs.sparkSession)
    table = fit_classes(blocks, totals, seeds, classes)
    pairs = transitions(blocks, table, classes)
    home, n = _by_state(totals, table, classes)
    states, v = classes + 2, float(home.sum())
    in_state = pairs.sum(0)  # every token is the second of one pair
    follow = np.log10((pairs + TRANSITION) / (pairs.sum(1, keepdims=True) + TRANSITION * states))
    gain = (follow - np.log10(in_state + EMISSION * (home + 1))).ravel()

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for hashes, codes, sizes, _ in _tokens_of(block.to_batches()):
            c = block["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)  # a group is one block
            c[counts["i"].to_numpy()] = counts["c"].to_numpy()
            state = np.where(c > 0, _states(table, hashes, classes), classes + 1)
            state[hashes == _hash(END)] = classes
            first, s = np.cumsum(sizes) - sizes, state[codes]
            logs = np.log10(c + EMISSION)[codes]
            steps = gain[_before(s, first + sizes - 1, classes) * states + s]
            out += [np.add.reduceat((c > 0)[codes].astype(np.int64), first), np.add.reduceat(logs, first), np.add.reduceat(steps, first)]
        if not out:
            return pa.table({name: pa.array([], kind) for name, kind in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("sum_log", pa.float64()), ("steps", pa.float64()))})
        flat = [block[name].combine_chunks().flatten() for name in ("doc_id", "held_out", "sizes")]
        return pa.table([*flat, *map(pa.array, out)], names=["doc_id", "held_out", "n_tokens", "n_known", "sum_log", "steps"])

    repeated = repeated_slots(every, len(table))
    known = listed_words(blocks, repeated).join(every.where("n > 1").select("w", "c"), "w").where("c <> own").select("home", "i", "c")
    coded = blocks.select("block", "doc_id", "held_out", "sizes", "hashes", "codes", "counts")
    scored = coded.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, steps double")
    base = F.col("sum_log") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("sum_log") + F.col("steps")).alias("score"))


def perplexity(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """(held_out, n_tokens, perplexity) of scored documents."""
    per = F.pow(F.lit(10.0), -F.sum(score_col) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per.alias("perplexity"))


def op6_brown(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 leaves other than 1 modulo 5."""
    from cadenza.llm.common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(docs.withColumn("held_out", in_fold(F.col("doc_id"), 5, 1)))
