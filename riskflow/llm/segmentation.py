"""
N-best segmentation of texts into the pieces of a SentencePiece model, and back.

A segmentation's score is the sum of its pieces' scores. Characters without a piece of their own are spelled in byte pieces, at a
score below all others. Of two characters that stand side by side in no piece, the first ends a piece and the second begins one, so a
text falls into stretches that are segmented on their own.

In a stretch's lattice, a forward Viterbi pass gives each place the best score of what precedes it. Searching backward from the end,
that is the exact value of what a partial path still has to come, so A-star takes the paths off its queue in order of their totals, and the
first N that reach the start are the N best. A text's N best then differ from its best in stretches whose own second choice costs
least: a search over those, best first, gives them in order.

Stretches get their best and second best score by the forward pass alone, the new ones of a batch of texts all at once, and are
remembered, up to a limit; the search backward runs where a text's N best need more. Every text is processed whole. Null texts are empty;
empty texts have no piece and one segmentation. Rows are taken one by one, so null ids and equal rows change nothing.
An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from array import array
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common

N = 3
#: Stretches and words that a worker remembers (twice that at most), and stretches whose N best it remembers.
REMEMBERED, CHOICES = 350_000, 10_000
#: Longest stretch, in characters, whose forward pass runs together with others', and how many characters run together.
SHORT, TOGETHER = 48, 200_000
SPACE = "▁"


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _member(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in `of`, which is sorted, and where."""
    if not len(of):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return of[at] == keys, at


class _Words(dict):
    """(ids as bytes, score, least cost of another choice, the word) of each word met so far, `prefix` before it."""

    def __init__(self, pieces: Pieces, prefix: str):
        self.pieces, self.prefix, self.older = pieces, prefix, {}

    def __missing__(self, word: str) -> tuple:
        if (found := self.older.get(word)) is None:
            found = self.pieces.word(self.prefix + word)
        self.put(word, found)
        return found

    def put(self, word: str, found: tuple) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = found


class Pieces:
    """The pieces of a model file and their scores."""

    def __init__(self, path: str, n: int = N):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, size = n, len(model)
        names = [model.id_to_piece(k) for k in range(size)]
        special = [model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(size)]
        self.score = {p: (model.get_score(k), k) for k, (p, s) in enumerate(zip(names, special, strict=True)) if not s}
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(names) if model.is_byte(k)}
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - 10
        #: The pieces by their characters: character -> (pieces that go on, score and id as bytes of the one that ends here).
        self.tree: dict = {}
        for piece, (score, number) in self.score.items():
            node = self.tree
            for n, character in enumerate(piece, 1):
                if character not in node:
                    node[character] = ({}, None, b"")
                if n == len(piece):
                    node[character] = (node[character][0], score, array("I", (number,)).tobytes())
                node = node[character][0]
        self.longest = max(map(len, self.score), default=1)
        # the same tree in arrays: (place in the tree, character) -> next place, where a piece may end
        steps: dict[int, int] = {}
        ends: dict[int, tuple[float, int]] = {}
        for piece, own in self.score.items():
            node = 0
            for character in piece:
                node = steps.setdefault(node << 21 | ord(character), len(steps) + 1)
            ends[node] = own
        self.steps = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.end_score, self.end_id = np.zeros(len(steps) + 1), np.full(len(steps) + 1, -1, np.int64)
        for node, (score, number) in ends.items():
            self.end_score[node], self.end_id[node] = score, number
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.pairs = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self.inside), np.int64)
        self.plain = all(SPACE not in p.strip(SPACE) and not (p.endswith(SPACE) and p.strip(SPACE)) for p in self.score) and not any("\n" in p for p in self.inside)
        self.text = [b"" if model.is_control(k) else bytes([int(p[3:5], 16)]) if model.is_byte(k) else b" \xe2\x81\x87 " if model.is_unknown(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(names)]
        self.choices: dict[str, list] = {}
        self.stretches: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.head, self.tail = _Words(self, ""), _Words(self, SPACE)

    def spelled(self, character: str) -> bytes:
        return array("I", [self.byte.get(b, self.model.unk_id()) for b in character.encode("utf-8", "replace")]).tobytes()

    def edges(self, text: str, start: int) -> list[tuple[int, float, bytes]]:
        """(end, score, ids as bytes) of the pieces that begin at a place."""
        out, node, end = [], self.tree, start
        for character in text[start : start + self.longest]:
            if (found := node.get(character)) is None:
                break
            end += 1
            node, score, ids = found
            if score is not None:
                out.append((end, score, ids))
        if not out or out[0][0] != start + 1:
            out.append((start + 1, self.unknown, self.spelled(text[start])))
        return out

    def forward(self, text: str) -> tuple[float, float, bytes]:
        """Best score of one stretch, the second best, and the ids of the best, by one Viterbi pass that keeps two scores a place."""
        size, low, tree = len(text), float("-inf"), self.tree
        best, second, back, own = [0.0] + [low] * size, [low] * (size + 1), [0] * (size + 1), [b""] * (size + 1)
        for start in range(size):
            one, two, node, end = best[start], second[start], tree, start
            # the same edges as in `edges`, without a list of them
            for character in text[start : start + self.longest]:
                if (found := node.get(character)) is None:
                    if end > start:
                        break
                    found = {}, self.unknown, self.spelled(character)
                end += 1
                node, score, ids = found
                if score is None:
                    if end > start + 1:
                        continue
                    score, ids = self.unknown, self.spelled(character)
                new = one + score
                if new > best[end]:
                    second[end] = max(best[end], two + score)
                    best[end], back[end], own[end] = new, start, ids
                elif new > second[end]:
                    second[end] = new
        place, chain = size, []
        while place:
            chain.append(own[place])
            place = back[place]
        chain.reverse()
        return best[size], second[size], b"".join(chain)

    def forwards(self, stretches: list[str]) -> list[tuple[float, float, bytes]]:
        """`forward` of many stretches."""
        out: list = [None] * len(stretches)
        held, size = [], 0
        for k, stretch in enumerate(stretches):
            if len(stretch) <= SHORT:
                held.append(k)
                size += len(stretch)
            if held and (size >= TOGETHER or k + 1 == len(stretches)):
                for h, found in zip(held, self._together([stretches[h] for h in held]), strict=True):
                    out[h] = found
                held, size = [], 0
        return [self.forward(s) if found is None else found for s, found in zip(stretches, out, strict=True)]

    def _together(self, stretches: list[str]) -> list[tuple[float, float, bytes] | None]:
        """
        `forward` of short stretches, None where one has a character without a piece of its own.

        All places go down the tree of pieces together; then all pieces that end equally far from their stretch's start, and are equally
        long, add to the scores there together.
        """
        chars = _characters("".join(stretches))
        n = len(stretches)
        sizes = np.fromiter(map(len, stretches), np.int64, n)
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(n), sizes)
        offset = np.arange(len(chars)) - begins[of]
        left = sizes[of] - offset
        place, node, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        alone, found = np.zeros(len(chars), bool), []
        while len(place):
            hit, at = _member(self.steps, node << 21 | chars[place + depth])
            place, node, depth = place[hit], self.next[at[hit]], depth + 1
            ends = self.end_id[node] >= 0
            found.append((place[ends], np.full(int(ends.sum()), depth), node[ends]))
            if depth == 1:
                alone[place[ends]] = True
            more = left[place] > depth
            place, node = place[more], node[more]
        place, length, node = (np.concatenate(x) for x in zip(*found, strict=True))
        group = (offset[place] + length) * (SHORT + 1) + SHORT - length
        order = np.argsort(group, kind="stable")
        place, length, node, group = place[order], length[order], node[order], group[order]
        score, start = self.end_score[node], place + of[place]
        end = start + length
        first = begins + np.arange(n)
        best, second, chosen = (np.full(len(chars) + n, x) for x in (-np.inf, -np.inf, -1))
        best[first] = 0.0
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, own = start[x:y], end[x:y], score[x:y]
            new, old = best[s] + own, best[e]
            second[e] = np.maximum(np.maximum(second[e], np.minimum(old, new)), second[s] + own)
            better = new > old
            best[e[better]] = new[better]
            chosen[e[better]] = x + np.flatnonzero(better)
        known = np.ones(n, bool)
        known[of[~alone]] = False
        last = first + sizes
        who, at, path = np.flatnonzero(known), last[known], []
        while len(who):
            edge = chosen[at]
            path.append((who, self.end_id[node[edge]]))
            more = start[edge] > first[who]
            who, at = who[more], start[edge[more]]
        counts = np.bincount(np.concatenate([w for w, _ in path]), minlength=n) if path else np.zeros(n, np.int64)
        stops = np.cumsum(counts)
        ids = np.zeros(int(stops[-1]), "<u4")
        for k, (who, numbers) in enumerate(path, 1):
            ids[stops[who] - k] = numbers
        raw, bytes_to = ids.tobytes(), (stops * 4).tolist()
        rows = zip(best[last].tolist(), second[last].tolist(), [0, *bytes_to[:-1]], bytes_to, known.tolist(), strict=True)
        return [(one, two, raw[x:y]) if whole else None for one, two, x, y, whole in rows]

    def nbest(self, text: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids as bytes) of one stretch, by forward Viterbi and backward A-star; the first is that of `forward`."""
        if (known := self.choices.get(text)) is not None:
            return known
        if len(self.choices) >= CHOICES:
            self.choices.clear()
        found = self._nbest(text)
        if len(text) <= SHORT:
            self.choices[text] = found
        return found

    def _nbest(self, text: str) -> list[tuple[float, bytes]]:
        size = len(text)
        into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(size + 1)]
        best = [0.0] + [float("-inf")] * size
        for start in range(size):
            for end, score, ids in self.edges(text, start):
                into[end].append((start, score, ids))
                best[end] = max(best[end], best[start] + score)
        # (-score of the whole path at best, number, place, score behind the place, ids behind it as a chain)
        queue, out, number = [(-best[size], 0, size, 0.0, None)], [], 0
        while queue and len(out) < self.n:
            total, _, place, behind, chain = heapq.heappop(queue)
            if not place:
                ids = []
                while chain:
                    ids.append(chain[0])
                    chain = chain[1]
                out.append((-total, b"".join(ids)))
                continue
            for start, score, ids in into[place]:
                number += 1
                heapq.heappush(queue, (-(behind + score + best[start]), number, start, behind + score, (ids, chain)))
        first = self.forward(text)[2]
        # of equally good ones, the same comes first in both
        return sorted(out, key=lambda x: (-x[0], x[1] != first)) if any(x[1] == first for x in out) else [(out[0][0], first), *out[: self.n - 1]]

    def cut(self, word: str) -> list[str]:
        """The stretches of a word."""
        ends = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inside]
        return [word[x:y] for x, y in zip([0, *ends], [*ends, len(word)], strict=True)] if word else []

    def costs(self, word: str) -> list[tuple[float, float, bytes]]:
        """Best score of each stretch of a word, what the second best costs, and ids of the best."""
        out, stretches = [], self.cut(word)
        for stretch in stretches:
            if stretch[0] == SPACE and (known := self.tail.get(stretch[1:])):
                found = known[1], known[2], known[0]
            elif (found := self.stretches.get(stretch) or self.older.get(stretch)) is None:
                best, second, ids = self.forward(stretch)
                found = best, best - second, ids
                if len(stretches) == 1:
                    return [found]  # what is a word of its own is remembered as one
                if len(self.stretches) >= REMEMBERED:
                    self.older, self.stretches = self.stretches, {}
                self.stretches[stretch] = found
            out.append(found)
        return out

    def word(self, word: str) -> tuple:
        found = self.costs(word)
        if len(found) == 1:
            best, cost, ids = found[0]
            return ids, best, cost, word
        return b"".join([f[2] for f in found]), sum(f[0] for f in found), min((f[1] for f in found), default=float("inf")), word

    def cuts(self, words: list[str]) -> list[list[str]]:
        """`cut` of many words, none of them empty."""
        text = "".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = [stops]
        for x in range(0, len(text), TOGETHER):
            chars = _characters(text[x : x + TOGETHER + 1])
            hit, _ = _member(self.pairs, chars[:-1] << 21 | chars[1:])
            ends.append(x + 1 + np.flatnonzero(~hit))
        places = np.unique(np.concatenate(ends))
        edges = [0, *places.tolist()]
        stretches = [text[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        upto = (np.searchsorted(places, stops) + 1).tolist()
        return [stretches[x:y] for x, y in zip([0, *upto[:-1]], upto, strict=True)]

    def learn(self, texts: list[str]) -> None:
        """Remember the words of some normalized texts; the new ones go through the forward pass together."""
        head, tail = set(), set()
        for whole in texts:
            if not self.plain or SPACE * 2 in whole:
                continue
            for line in whole.split("\n"):
                first, *others = line.split(SPACE)
                head.add(first)
                tail.update(others)
        head.discard("")
        for kept, met in ((self.head, head), (self.tail, tail)):
            fresh = [w for w in met if w not in kept and w not in kept.older]
            if not fresh:
                continue
            cut = self.cuts([kept.prefix + w for w in fresh])
            distinct = list(dict.fromkeys(s for own in cut for s in own))
            found = dict(zip(distinct, self.forwards(distinct), strict=True))
            for word, own in zip(fresh, cut, strict=True):
                parts = [found[s] for s in own]
                if len(parts) == 1:
                    best, second, ids = parts[0]
                    kept.put(word, (ids, best, best - second, kept.prefix + word))
                else:
                    kept.put(word, (b"".join([f[2] for f in parts]), sum(f[0] for f in parts), min(f[0] - f[1] for f in parts), kept.prefix + word))

    def words(self, whole: str) -> list[tuple]:
        """The words of a normalized text."""
        if not self.plain or SPACE * 2 in whole:
            return [self.word(whole)]
        out, head, tail = [], self.head.__getitem__, self.tail.__getitem__
        for n, line in enumerate(whole.split("\n")):
            if n:
                out.append(head("\n"))
            parts = iter(line.split(SPACE))
            if first := next(parts):
                out.append(head(first))
            out.extend(map(tail, parts))
        return out

    def normalized(self, texts: list[str | None]) -> list[str]:
        return [self.model.normalize(text or "") for text in texts]

    def segment(self, text: str | None, whole: str | None = None) -> tuple[list[tuple], list[tuple[float, dict]]]:
        """Words of a text, and its N best as (score, {(word, stretch): ids as bytes} where not the best of the stretch)."""
        words = self.words(self.normalized([text])[0] if whole is None else whole)
        score = sum(map(itemgetter(1), words))
        costs = np.fromiter(map(itemgetter(2), words), float, len(words))
        few = np.argpartition(costs, self.n - 2)[: self.n - 1] if len(costs) >= self.n > 1 else np.arange(len(costs))
        options = sorted((cost, int(w), k) for w in few for k, (_, cost, _) in enumerate(self.costs(words[w][3])) if cost < float("inf"))
        options = options[: self.n - 1]
        choices = [self.nbest(self.cut(words[w][3])[k]) for _, w, k in options]
        lists = [[own[0][0] - c[0] for c in own] for own in choices]
        return words, [
            (score - cost, {options[o][1:]: choices[o][j][1] for o, j in enumerate(picks) if j}) for cost, picks in _cheapest(lists, self.n)
        ]

    def ids(self, words: list[tuple], changed: dict | None = None) -> np.ndarray:
        """Ids of a segmentation."""
        parts = list(map(itemgetter(0), words))
        for w in {w for w, _ in changed or ()}:
            parts[w] = b"".join(changed.get((w, k)) or ids for k, (_, _, ids) in enumerate(self.costs(words[w][3])))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes put together, space marks turned into spaces, the leading one left out."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _cheapest(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to take one of each list, each list ascending from 0."""
    start = (0,) * len(lists)
    queue, seen, out = [(0.0, start)], {start}, []
    while queue and len(out) < n:
        cost, picks = heapq.heappop(queue)
        out.append((cost, picks))
        for k, own in enumerate(lists):
            if picks[k] + 1 < len(own):
                more = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (cost - own[picks[k]] + own[picks[k] + 1], more))
    return out


DIGEST = "n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean"
FULL = "ids array<int>, score double, nbest_scores array<double>, decoded string"


def segmented(text: Column, model: str, n: int = N, full: bool = False) -> Column:
    """
    The N best segmentations of a text as a struct.

    `full`: ids, score and decoded text of the best, and the scores of all. Otherwise digests of the same: number of pieces, crc32 of
    ids as little-endian u32, sha256 of the decoded text, and whether that is the text.
    """

    @F.pandas_udf(FULL if full else DIGEST)
    def run(texts: pd.Series) -> pd.DataFrame:
        pieces = common.per_worker(("pieces", model, n), lambda: Pieces(model, n))
        rows = []
        normalized = pieces.normalized(texts.tolist())
        pieces.learn(normalized)
        for text, whole in zip(texts, normalized, strict=True):
            words, best = pieces.segment(text, whole)
            ids = pieces.ids(words)
            decoded = pieces.decode(ids)
            scores = [s for s, _ in best]
            if full:
                rows.append((ids.astype(np.int32), scores[0], scores, decoded))
            else:
                others = [zlib.crc32(pieces.ids(words, changed).tobytes()) for _, changed in best]
                rows.append((len(ids), others[0], scores[0], scores, others, hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in (FULL if full else DIGEST).split(", ")])

    return run(text)


def op6_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best segmentations of every document by the 32k byte-fallback model, and the best one decoded."""
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    found = segmented(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")
