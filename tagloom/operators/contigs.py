"""Molecules whose reads do not all begin at one place: reads placed by shared words, mates merged.

Each molecule's reads are placed within one Arrow function call. An
index of all reads' words names, for a read, the later ones that share some, so reads
without a common word are never compared; a word whose reads have all been joined is
closed, so a pile of like reads costs one look a read. Reads that share words but never
enough to be joined are still looked at in pairs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import reverse_complement
from .consensus import FLOOR, LETTERS, PHRED_OFFSET, by_molecule, call_columns, voting

WORD = 15
VOTES = 3
OVERLAP = 20
PAIRS_TRIED = 8
AGREE = 2
REMEMBERED = 10_000  # pairs of mates in a task


def _places(seq: bytes) -> dict[bytes, int]:
    """Where each word of a read first stands."""
    out: dict[bytes, int] = {}
    for i in range(len(seq) - WORD + 1):
        out.setdefault(seq[i : i + WORD], i)
    return out


def _offset(one: bytes, other: bytes) -> int | None:
    """Where the other read begins on the one: each of its words votes by where the one first has it; ties to the smaller. None if too few vote or too little overlaps."""
    first = _places(one)
    votes = Counter(first[w] - j for j in range(len(other) - WORD + 1) if (w := other[j : j + WORD]) in first)
    if not votes:
        return None
    offset, n_votes = min(votes.items(), key=lambda v: (-v[1], v[0]))
    overlap = min(len(one), offset + len(other)) - max(0, offset)
    return offset if n_votes >= VOTES and overlap >= OVERLAP else None


class _Words:
    """Where every word of a molecule's reads stands, by read and by word."""

    def __init__(self, seqs: list[bytes]):
        lengths = np.array([max(0, len(s) - WORD + 1) for s in seqs], np.int64)
        text = np.frombuffer(b"".join(s for s, n in zip(seqs, lengths) if n), np.uint8)
        whole = np.where(lengths > 0, lengths + WORD - 1, 0)
        self.read = np.repeat(np.arange(len(seqs)), lengths)
        self.at = np.arange(len(self.read)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        begins = np.repeat(np.cumsum(whole) - whole, lengths) + self.at
        windows = np.lib.stride_tricks.sliding_window_view(text, WORD)[begins] if len(begins) else np.empty((0, WORD), np.uint8)
        _, self.word = np.unique(np.ascontiguousarray(windows).view(f"S{WORD}").ravel(), return_inverse=True)
        self.end_of_read = np.cumsum(lengths)
        self.lengths = lengths
        order = np.argsort(self.word, kind="stable")  # of each word: by read, then by place
        self.by_word = order
        counts = np.bincount(self.word, minlength=1) if len(self.word) else np.zeros(1, np.int64)
        self.begin, self.count = np.cumsum(counts) - counts, counts
        self.open = counts > 1

    def votes(self, i: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(later read, offset of it on read ``i``) once a vote, of reads in another group than ``i``."""
        mine = slice(self.end_of_read[i] - self.lengths[i], self.end_of_read[i])
        words, first = np.unique(self.word[mine], return_index=True)
        words, first = words[self.open[words]], first[self.open[words]]
        counts = self.count[words]
        heads = np.cumsum(counts) - counts
        hits = self.by_word[np.repeat(self.begin[words] - heads, counts) + np.arange(counts.sum())]
        apart = group[self.read[hits]] != group[i]
        if len(words):
            self.open[words[~np.logical_or.reduceat(apart, heads)]] = False  # groups only grow, so these have nothing to add
        later = apart & (self.read[hits] > i)
        place = np.repeat(self.at[mine][first], counts)
        return self.read[hits[later]], (place - self.at[hits])[later]


def place(seqs: list[bytes]) -> list[list[tuple[int, int]]]:
    """Reads as contigs of (read, offset from the first base): joined pair by pair in order, largest contig first, then by smallest sequence."""
    group, shift = np.arange(len(seqs)), np.zeros(len(seqs), np.int64)
    members = [[i] for i in range(len(seqs))]
    sizes = np.array([len(s) for s in seqs], np.int64)
    words = _Words(seqs)
    wide = int(sizes.max(initial=0)) + 1
    for i in range(len(seqs)):
        if len(members[group[i]]) == len(seqs):
            break
        reads, offsets = words.votes(i, group)
        if len(reads) < VOTES:
            continue
        pairs, n = np.unique(reads * (2 * wide) + offsets + wide, return_counts=True)
        read, offset = pairs // (2 * wide), pairs % (2 * wide) - wide
        best = np.lexsort((offset, -n, read))
        best = best[np.r_[True, read[best][1:] != read[best][:-1]]]
        read, offset, n = read[best], offset[best], n[best]
        overlap = np.minimum(sizes[i], offset + sizes[read]) - np.maximum(0, offset)
        for j, x in zip(*(v[(n >= VOTES) & (overlap >= OVERLAP)].tolist() for v in (read, offset))):
            a, b = group[i], group[j]
            if a == b:
                continue
            by = shift[i] + x - shift[j]  # what moves the other's group onto this one's
            if len(members[a]) < len(members[b]):
                a, b, by = b, a, -by
            shift[members[b]] += by
            group[members[b]] = a
            members[a] += members[b]
            members[b] = []
    out = []
    for reads in members:
        if reads:
            least = int(shift[reads].min())
            out.append([(i, int(shift[i]) - least) for i in sorted(reads)])
    return sorted(out, key=lambda g: (-len(g), min(seqs[i] for i, _ in g)))


def _called(seqs: list[bytes], quals: list[bytes], placed: list[tuple[int, int]], floor: float) -> tuple[str, str, float, float]:
    """Consensus of placed reads, from the first base of any to the last."""
    width = max(x + len(seqs[i]) for i, x in placed)
    # Places that a read does not reach hold letters that do not vote.
    rows = [(b"N" * x + seqs[i]).ljust(width, b"N") for i, x in placed]
    marks = [(b"!" * x + quals[i][: len(seqs[i])].ljust(len(seqs[i]), b"!")).ljust(width, b"!") for i, x in placed]
    _, bases, p, q, _ = call_columns(rows, marks, np.array([0]), floor)
    return LETTERS[bases].tobytes().decode(), (q + PHRED_OFFSET).astype(np.uint8).tobytes().decode(), float(p.mean()), float(q.mean())


CONTIG = "reads long, contig int, contigs int, seq string, qual string, mean_error double, mean_quality double"
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64())


def contigs(reads: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), floor: float = FLOOR, cap: int | None = None) -> DataFrame:
    """(keys, reads, contig, contigs, seq, qual, mean_error, mean_quality): one row per group of reads that overlap; reads are the contig's."""

    def run(seqs, quals, starts):
        which, out = [], []
        for g, (start, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(seqs)])):
            some, marks = seqs[start:end], quals[start:end]
            found = [c for c in place(some) if any(some[i] for i, _ in c)]
            for k, c in enumerate(found, 1):
                which.append(g)
                out.append((len(c), k, len(found), *_called(some, marks, c, floor)))
        return which, [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES]

    votes, _ = voting(reads, keys, cap)
    return by_molecule(votes, keys, run, CONTIG)


def merge_offset(firsts: list[bytes], seconds: list[bytes], known: dict | None = None) -> int | None:
    """Where turned second mates begin on first mates: voted by the first pairs, until two agree; ties to the smaller. ``known``: offsets of pairs met before."""
    votes, known = Counter(), {} if known is None else known
    for pair in list(zip(firsts, seconds))[:PAIRS_TRIED]:
        if pair not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[pair] = _offset(*pair)
        if (offset := known[pair]) is not None:
            votes[offset] += 1
            if votes[offset] == AGREE:
                break
    return min(votes.items(), key=lambda v: (-v[1], v[0]))[0] if votes else None


def merged_mates(pairs: DataFrame, keys: tuple[str, ...] = ("sample_id", "umi"), floor: float = FLOOR, cap: int | None = None) -> DataFrame:
    """(keys, reads, contig, contigs, seq, qual, mean_error, mean_quality) of pairs (seq, qual, seq2, qual2): one contig where the mates overlap, else two.

    Second mates are turned round; one offset holds for all pairs of a molecule. All contigs
    of a batch are called at once.
    """
    bar = F.lit("|")
    joined = pairs.withColumn("seq", F.concat("seq", bar, reverse_complement("seq2"))).withColumn("qual", F.concat("qual", F.lit("!"), F.reverse("qual2")))

    known: dict[tuple[bytes, bytes], int | None] = {}

    def run(seqs, quals, starts):
        which, out, rows, marks, begin = [], [], [], [], []

        def add(g: int, n: int, contig: int, contigs: int, mates: list[tuple[bytes, bytes, int]]) -> None:
            width = max(x + len(s) for s, _, x in mates)
            which.append(g)
            out.append((n, contig, contigs))
            begin.append(len(rows))
            # Places that a mate does not reach hold letters that do not vote.
            rows.extend([(b"N" * x + s).ljust(width, b"N") for s, _, x in mates])
            marks.extend([(b"!" * x + q[: len(s)].ljust(len(s), b"!")).ljust(width, b"!") for s, q, x in mates])

        for g, (start, end) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(seqs)])):
            halves = [s.split(b"|") for s in seqs[start:end]]
            n, offset = end - start, merge_offset([h[0] for h in halves[:PAIRS_TRIED]], [h[1] for h in halves[:PAIRS_TRIED]], known)
            low = min(0, offset or 0)
            firsts = [(h[0], q[: len(h[0])], -low) for h, q in zip(halves, quals[start:end])]
            seconds = [(h[1], q[len(h[0]) + 1 :], (offset or 0) - low) for h, q in zip(halves, quals[start:end])]
            if offset is not None:
                add(g, n, 1, 1, firsts + seconds)
            else:
                for k, mates in enumerate((firsts, seconds), 1):
                    if any(s for s, _, _ in mates):
                        add(g, n, k, 2, mates)
        if not which:
            return which, [pa.array([], t) for t in _TYPES]
        widths, bases, p, q, _ = call_columns(rows, marks, np.array(begin, np.int64), floor)
        text, phred = LETTERS[bases].tobytes().decode(), (q + PHRED_OFFSET).astype(np.uint8).tobytes().decode()
        ends = np.cumsum(widths)
        spans = list(zip((ends - widths).tolist(), ends.tolist()))
        means = [np.add.reduceat(x, ends - widths) / widths for x in (p, q.astype(float))]
        columns = [*zip(*out), [text[a:b] for a, b in spans], [phred[a:b] for a, b in spans], *means]
        return which, [pa.array(c, t) for c, t in zip(columns, _TYPES)]

    votes, _ = voting(joined, keys, cap)
    return by_molecule(votes, keys, run, CONTIG)
