"""Byte-level BPE vocabularies and the two exact algorithms over them.

``Vocab.replay`` encodes many words at once: an inverted index from token pair to
positions, merges taken in rank order, only the neighbours of a merge looked at again.
``Vocab.prefix_counts`` finds the token count of every prefix of every word by dynamic
programming over the words' shared prefixes.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import regex

#: The pattern that byte_bpe_50k and byte_bpe_multi_50k were trained with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_SHIFT = 20
_NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this take the scalar path of prefix_counts.
_WIDE = 48


class Vocab:
    """Ranks of byte strings, as in a .tiktoken file; a token's id is its rank."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for t, r in ranks.items():
            self.token_bytes[r] = t
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int32)
        self.max_len = int(self.lengths.max())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a = ranks.get(t[:i])
                b = ranks.get(t[i:]) if a is not None else None
                if b is not None:
                    pairs[a << _SHIFT | b] = r
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        vals = np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], vals[order]
        self.byte_pairs = np.full((257, 257), _NONE, np.int32)
        of = {int(self.byte_ids[b]): b for b in range(256)}
        for k, r in pairs.items():
            a, b = of.get(k >> _SHIFT), of.get(k & ((1 << _SHIFT) - 1))
            if a is not None and b is not None:
                self.byte_pairs[a, b] = r
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths[:-1])]).astype(np.int64)
        self._dp_ready = False

    # corpus-level merge replay

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, _NONE where the two don't merge (or one is a gap)."""
        code = (a.astype(np.int64) << _SHIFT) | b
        code[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.pair_keys, code)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == code, self.pair_ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of each word's tokens."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        joined = b"\0".join([b"", *words, b""])
        raw = np.frombuffer(joined, np.uint8)
        lens = np.fromiter(map(len, words), np.int64, n)
        gaps = np.concatenate([[0], np.cumsum(lens + 1)])
        size = len(raw)
        sym = self.byte_ids[raw]
        sym[gaps] = -1
        span = np.ones(size + 1, np.int32)
        ends_at = np.arange(-1, size + 1, dtype=np.int32)  # start of the symbol that ends before a position
        wide = raw.astype(np.int32)
        wide[gaps] = 256
        first = self.byte_pairs[wide[:-1], wide[1:]]
        pos = np.flatnonzero(first != _NONE)
        rank = first[pos]
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        heads = rank[np.concatenate([[0], cuts])].tolist() if len(rank) else []
        index: dict[int, np.ndarray] = dict(zip(heads, np.split(pos, cuts))) if heads else {}
        later: dict[int, list[int]] = {}
        heap = heads  # ascending, so a heap already
        while heap:
            r = heapq.heappop(heap)
            p = index.pop(r, None)
            more = later.pop(r, None)
            if more is not None:
                more = np.array(more, np.int64)
                p = more if p is None else np.concatenate([p, more])
            if p is None:
                continue
            q = p + span[p]
            length = int(self.lengths[r])
            ok = (sym[p] >= 0) & (sym[q] >= 0) & (span[p] + span[q] == length)
            p = p[ok]
            if not len(p):
                continue
            p = np.unique(p)
            q = p + span[p]
            touch = q[:-1] == p[1:]
            if touch.any():  # runs such as aaaa: the leftmost goes first
                idx = np.arange(len(p))
                head = np.concatenate([[True], ~touch])
                keep = (idx - np.maximum.accumulate(np.where(head, idx, 0))) % 2 == 0
                p, q = p[keep], q[keep]
            sym[p] = r
            sym[q] = -2
            span[p] = length
            span[q] = 0
            after = p + length
            ends_at[after] = p
            before = ends_at[p]
            at = np.concatenate([before, p])
            left, right = np.concatenate([sym[before], sym[p]]), np.concatenate([sym[p], sym[after]])
            new = self.pair_rank(left, right)
            hit = new != _NONE
            for x, y in zip(new[hit].tolist(), at[hit].tolist()):
                there = later.get(x)
                if there is None:
                    later[x] = [y]
                    if x not in index:
                        heapq.heappush(heap, x)
                else:
                    there.append(y)
        live = sym >= 0
        counts = np.add.reduceat(live.astype(np.int64), gaps[:-1]) if n else lens
        return sym[live], counts

    def encode_word(self, word: bytes) -> list[int]:
        return self.replay([word])[0].tolist()

    # prefix counts

    def _prepare(self) -> None:
        """Each token's last merge, found in rank order; tokens that BPE never makes have none."""
        left, right = [-1] * self.size, [-1] * self.size
        self.left, self.right = left, right
        self.usable = np.zeros(self.size, bool)
        self.usable[self.byte_ids] = True
        self.memo: dict[int, bool] = {}
        ranks = self.ranks
        for r, t in enumerate(self.token_bytes):
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None and a < self.size and self.usable[a] and self.usable[b] and self._fits(a, b, r):
                    left[r], right[r] = a, b
                    self.usable[r] = True
                    break
        for b in self.byte_ids.tolist():
            self.usable[b] = True
        use = np.flatnonzero(self.usable)
        keys = np.array([self._hash(self.token_bytes[r]) for r in use.tolist()], np.uint64)
        order = np.argsort(keys)
        self.hash_keys, self.hash_ids = keys[order], use[order].astype(np.int32)
        self.by_bytes = {self.token_bytes[r]: r for r in use.tolist()}
        self.use_len = int(self.lengths[use].max())
        self.powers = np.ones(self.use_len + 1, np.uint64)
        for i in range(1, self.use_len + 1):
            self.powers[i] = np.uint64(int(self.powers[i - 1]) * int(_BASE) % 2**64)
        self._dp_ready = True

    @staticmethod
    def _hash(t: bytes) -> int:
        h = 0
        for b in t:
            h = (h * int(_BASE) + b + 1) % 2**64
        return h

    def _fits(self, a: int, b: int, limit: int = 2**31 - 1) -> bool:
        """Whether BPE leaves token a followed by token b as they are: undo their merges, latest first, and
        look whether the two sides of the border would have merged before (limit: merges of that rank and later don't count)."""
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            c = pairs.get(a << _SHIFT | b)
            if c is not None and c < limit:
                return False
            ra = a if right[a] >= 0 else -1
            rb = b if left[b] >= 0 else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def _compatible(self, code: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(code, return_inverse=True)
        memo, fits, mask = self.memo, self._fits, (1 << _SHIFT) - 1
        if len(memo) > 2_000_000:
            memo.clear()
        out = np.empty(len(uniq), bool)
        for i, c in enumerate(uniq.tolist()):
            v = memo.get(c)
            if v is None:
                v = memo[c] = fits(c >> _SHIFT, c & mask)
            out[i] = v
        return out[back]

    def prefix_counts(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word, the number of tokens of each of its byte prefixes (lengths 1 to len(word))."""
        if not self._dp_ready:
            self._prepare()
        out: list[np.ndarray | None] = [None] * len(words)
        narrow = []
        for i, w in enumerate(words):
            if len(w) > _WIDE:
                out[i] = self._prefix_scalar(w)
            else:
                narrow.append(i)
        narrow.sort(key=words.__getitem__)
        for i, row in zip(narrow, self._prefix_narrow([words[i] for i in narrow])):
            out[i] = row
        return out

    def _prefix_scalar(self, w: bytes) -> np.ndarray:
        last, counts = [0] * (len(w) + 1), np.zeros(len(w) + 1, np.int32)
        get, fits, widest = self.by_bytes.get, self._fits, self.use_len
        for i in range(1, len(w) + 1):
            for length in range(min(i, widest), 0, -1):
                t = get(w[i - length : i])
                if t is not None and (i == length or fits(last[i - length], t)):
                    last[i], counts[i] = t, counts[i - length] + 1
                    break
        return counts[1:]

    def _prefix_narrow(self, words: list[bytes]) -> list[np.ndarray]:
        """words are sorted. Level i holds the distinct prefixes of length i; a prefix's last token is the one
        suffix in the vocabulary that fits the last token of what is before it."""
        n = len(words)
        if not n:
            return []
        lens = np.fromiter(map(len, words), np.int64, n)
        widest = int(lens.max())
        mat = np.frombuffer(b"".join(w.ljust(widest, b"\0") for w in words), np.uint8).reshape(n, widest)
        node = np.zeros(n, np.int64)  # of each word at the level
        counts = np.zeros((n, widest), np.int32)
        hashes, lasts, totals, parents = [np.zeros(1, np.uint64)], [np.full(1, -1, np.int32)], [np.zeros(1, np.int32)], [np.zeros(1, np.int64)]
        new = np.zeros(n, bool)
        new[0] = True
        rows = np.arange(n)
        for i in range(1, widest + 1):
            alive = lens[rows] >= i
            if not alive.all():
                # a dropped word's first-of-prefix mark passes to the next word that has the same prefix: recompute from nodes
                rows = rows[alive]
            if not len(rows):
                break
            parent = node[rows]
            b = mat[rows, i - 1]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (parent[1:] != parent[:-1]) | (b[1:] != b[:-1])
            here = np.cumsum(fresh) - 1
            heads = np.flatnonzero(fresh)
            par, byte = parent[heads], b[heads]
            h = hashes[-1][par] * _BASE + byte.astype(np.uint64) + np.uint64(1)
            m = len(heads)
            token = np.full((min(i, self.use_len), m), -1, np.int32)
            before = np.full((min(i, self.use_len), m), 0, np.int64)
            a = par
            for length in range(1, min(i, self.use_len) + 1):
                sub = h - hashes[i - length][a] * self.powers[length]
                at = np.searchsorted(self.hash_keys, sub)
                at[at == len(self.hash_keys)] = 0
                token[length - 1] = np.where(self.hash_keys[at] == sub, self.hash_ids[at], -1)
                before[length - 1] = a
                if length < i:
                    a = parents[i - length][a]
            last, total = np.full(m, -1, np.int32), np.zeros(m, np.int32)
            open_ = np.ones(m, bool)
            for length in range(min(i, self.use_len), 0, -1):
                at = np.flatnonzero(open_ & (token[length - 1] >= 0))
                if not len(at):
                    continue
                t, prior = token[length - 1][at], before[length - 1][at]
                if length < i:
                    ok = self._compatible((lasts[i - length][prior].astype(np.int64) << _SHIFT) | t)
                    at, t, prior = at[ok], t[ok], prior[ok]
                last[at], total[at] = t, totals[i - length][prior] + 1
                open_[at] = False
            hashes.append(h)
            lasts.append(last)
            totals.append(total)
            parents.append(par)
            node[rows] = here
            counts[rows, i - 1] = total[here]
        return [counts[k, :x] for k, x in enumerate(lens.tolist())]


@lru_cache(maxsize=4)
def vocab_of(content: bytes) -> Vocab:
    return Vocab(content)


class Codec:
    """Texts to tokens through a dictionary of space-delimited chunks; a worker keeps it from batch to batch.

    A chunk is what lies between two single spaces, with the space before it. Where both neighbours of every
    space are visible characters, the pattern always starts a word at the space, so chunks can be encoded on
    their own. Texts with other white space around a space, and other patterns, are split as a whole.
    A key that starts with a space stands for the rest of the key as it is; any other key for itself after a space.
    """

    #: Chunks and words that are kept; the prefix counts work alone in their job and have room for more.
    CAP = 250_000
    PREFIX_CAP = 500_000

    def __init__(self, vocab: Vocab, pattern: str = PATTERN, prefixes: bool = False):
        self.vocab, self.prefixes = vocab, prefixes
        self.split = regex.compile(pattern).findall
        self.cap = self.word_cap = self.PREFIX_CAP if prefixes else self.CAP
        self.chunked = pattern == PATTERN
        self.clear()
        self.clear_words()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rough = np.zeros(0, bool)
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.prefixes:
            self.total = np.zeros(0, np.int64)

    def clear_words(self) -> None:
        """Words recur in many chunks (with other marks around them): their tokens (or prefix counts) outlive the chunks."""
        self.words: dict[str, int] = {}
        self.word_flat, self.word_start, self.word_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_total = np.zeros(0, np.int64)

    def _word_ids(self, words: list[str]) -> np.ndarray:
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            encoded = [w.encode() for w in new]
            tokens, n = self._prefix_words(encoded) if self.prefixes else self.vocab.replay(encoded)
            base = len(known)
            for i, w in enumerate(new):
                known[w] = base + i
            self.word_start = np.concatenate([self.word_start, len(self.word_flat) + np.cumsum(n) - n])
            if self.prefixes:
                self.word_total = np.concatenate([self.word_total, tokens[np.cumsum(n) - 1].astype(np.int64)])
            self.word_flat = np.concatenate([self.word_flat, tokens])
            self.word_count = np.concatenate([self.word_count, n])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _literal(self, key: str) -> str:
        return " " + key if key[:1] != " " else key[2:] if key[1:2] == " " else key[1:]

    def _learn(self, keys: list[str]) -> None:
        """Adds the chunks that aren't known yet."""
        split = self.split
        self.ids.update(zip(keys, range(len(self.ids), len(self.ids) + len(keys))))
        rough, per = np.zeros(len(keys), bool), np.ones(len(keys), np.int64)
        words: list[str] = []
        odd: list[tuple[int, str]] = []  # chunks that are more than one word of letters
        for i, k in enumerate(keys):
            if k.isalpha():
                words.append(" " + k)
                continue
            x = self._literal(k)
            own = split(x)
            words += own
            per[i] = len(own)
            rough[i] = not k or (k[0] != " " and (k[0].isspace() or k[-1].isspace()))
            odd.append((i, x))
        if len(self.words) > self.word_cap:
            self.clear_words()
        at = self._word_ids(words)
        if self.prefixes:
            flat, chunk_n, totals = self._prefix_rows(odd, at, per)
            self.total = np.concatenate([self.total, totals])
        else:
            flat, sizes = gather(self.word_flat, self.word_start, self.word_count, at)
            chunk_n = sums(sizes, per)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(chunk_n) - chunk_n])
        self.flat = np.concatenate([self.flat, flat])
        self.count = np.concatenate([self.count, chunk_n])
        self.rough = np.concatenate([self.rough, rough])

    def _prefix_words(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at every character of every word, one after the other, and the words' lengths."""
        rows = self.vocab.prefix_counts(encoded)
        flat, n = np.concatenate(rows), np.fromiter(map(len, encoded), np.int64, len(encoded))
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.append((raw[1:] & 0xC0) != 0x80, True)  # the last bytes of characters
        for w in (b"'re", b"'ve", b"'ll"):  # a prefix of two characters is two words yet
            if w in encoded:
                i = encoded.index(w)
                at = int(n[:i].sum())
                flat[at : at + 2] = 1, 2
        return flat[ends], sums(ends.astype(np.int64), n)

    def _prefix_rows(self, odd: list[tuple[int, str]], at: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token counts at every character of every chunk, counted from the chunk's start."""
        flat, lens = gather(self.word_flat, self.word_start, self.word_count, at)
        tot = self.word_total[at]
        before = np.cumsum(tot) - tot
        chunk_tot = sums(tot, per)
        chunk_base = np.repeat(np.cumsum(chunk_tot) - chunk_tot, per)
        flat = flat + np.repeat((before - chunk_base).astype(np.int32), lens)
        sizes = sums(lens, per)
        starts = np.cumsum(sizes) - sizes
        for i, x in odd:
            if len(x) > 1 and _SPACES.search(x):
                for m in _SPACES.finditer(x):  # inside a run of white space, the prefix's last word is the run so far
                    at = int(starts[i]) + m.start()
                    run = m.group().encode()
                    c = self.vocab.prefix_counts([run])[0]
                    b = np.frombuffer(run, np.uint8)
                    c = c[np.append((b[1:] & 0xC0) != 0x80, True)]
                    flat[at : at + len(c)] = c + (flat[at - 1] if m.start() else 0)
        return flat, sizes, chunk_tot

    def keys(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The chunks of all texts, one after the other, and how many each text has."""
        keys: list[str] = []
        per = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            part = t.split(" ") if self.chunked else [" " + t]
            if self.chunked:
                part[0] = " " + part[0]
            per[i] = len(part)
            keys += part
        return keys, per

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > self.cap:
            self.clear()
        keys, per = self.keys(texts)
        new = [k for k in dict.fromkeys(keys) if k not in self.ids] if self.ids else list(dict.fromkeys(keys))
        if new:
            self._learn(new)
        ids = np.fromiter(map(self.ids.__getitem__, keys), np.int64, len(keys))
        rough = self.rough[ids]
        ends = np.cumsum(per)
        edge = np.zeros(len(ids), bool)
        first = ends - per
        edge[first] = True
        # the first chunk ends in white space, or white space stands before the first space
        bad = sums(rough.astype(np.int64), per) > 0
        for i in np.flatnonzero(per > 1).tolist():
            k = keys[first[i]]
            if len(k) == 1 or k[-1].isspace():
                bad[i] = True
        if self.chunked and bad.any():
            lists = []
            for i in np.flatnonzero(bad).tolist():
                lists.append(["  " + x for x in self._whole(texts[i])])
            new = [k for k in dict.fromkeys(k for x in lists for k in x) if k not in self.ids]
            if new:
                self._learn(new)
            pieces, at, j = [], 0, 0
            for i in np.flatnonzero(bad).tolist():
                pieces.append(ids[at : first[i]])
                pieces.append(np.fromiter((self.ids[k] for k in lists[j]), np.int64, len(lists[j])))
                per[i] = len(lists[j])
                at, j = ends[i], j + 1
            pieces.append(ids[at:])
            ids = np.concatenate(pieces)
        return ids, per

    def _whole(self, text: str) -> list[str]:
        """Pieces of a text that can be handled on their own: words, or (for prefixes) stretches that end before white space."""
        return _STRETCH.findall(text) if self.prefixes else self.split(text)


_SPACES = regex.compile(r"\s{2,}")
#: A run of white space and what follows it, up to the next run.
_STRETCH = regex.compile(r"\s+\S*|\S+")


def sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes (which may be 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ids of a ragged array, one after the other, and their lengths."""
    n = counts[ids] if len(ids) else np.zeros(0, np.int64)
    total = int(n.sum())
    if not total:
        return flat[:0], n
    shift = starts[ids] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(total)], n
