"""Byte pair merges over many words at once: exact merging, greedy proposals and the check of adjacent tokens."""

import heapq
import json

import numpy as np

from tracewell.llm.common import starts_of

NONE = np.int32(-1)
#: Rank of a pair that no merge joins, and the time at which a whole token is used up.
NEVER = np.int32(1 << 30)
#: Words that are merged at a time, so that the arrays stay in the processor's cache.
TOGETHER = 4096
#: Bytes of a word from which on it is merged alone.
LONG = 2048


class Lookup:
    """Values of unsigned keys, found for whole arrays: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            open_ = todo[self.values[slot[todo]] == NONE]
            _, first = np.unique(slot[open_], return_index=True)
            put = open_[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out != NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.values[slot[todo]]
            todo = todo[(self.keys[slot[todo]] != keys[todo]) & (out[todo] != NONE)]
        return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A byte-level vocabulary with its merges in order, from the text of a tokenizer file."""

    def __init__(self, definition: str):
        model = json.loads(definition)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        size = max(vocab.values()) + 1
        self.left, self.right = np.full(size, NONE), np.full(size, NONE)
        self.rank = np.full(size, NONE)
        keys, made, sound = [], [], np.ones(size, bool)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append(x << 32 | y)
            made.append(z)
            if self.rank[z] >= 0 or rank <= max(self.rank[x], self.rank[y]):
                sound[z] = False
            else:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
        self.merge_ids = np.array(made, np.int32)
        self.rank_of_pair: dict[int, int] = {}
        self.pairs = Lookup(np.array(keys, np.uint64), np.arange(len(keys), dtype=np.int32))
        of = {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            if all(c in of for c in token):
                self.bytes_of[i] = bytes(map(of.__getitem__, token))
        if not suffix:
            self._trie()
            ids = np.array(sorted(self.bytes_of), np.int32)
            back, counts = self.exact([self.bytes_of[i] for i in ids.tolist()])
            alone = np.zeros(size, bool)
            whole = counts == 1
            alone[ids[whole]] = back[starts_of(counts)[whole]] == ids[whole]
            self.sound = sound & alone

    def _trie(self) -> None:
        known, token_at, edges = {b"": 0}, [-1], []
        for i, token in sorted(self.bytes_of.items()):
            for n in range(1, len(token) + 1):
                if token[:n] not in known:
                    known[token[:n]] = len(token_at)
                    edges.append((known[token[:n - 1]] << 8 | token[n - 1], len(token_at)))
                    token_at.append(-1)
            token_at[known[token]] = i
        keys, nodes = zip(*edges)
        self.edges, self.token_at = Lookup(np.array(keys, np.uint64), np.array(nodes, np.int32)), np.array(token_at, np.int32)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(found >= 0, found, NEVER)

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their number by word, by merging the pair of least rank, leftmost first.

        Words are merged together, TOGETHER at a time; one of more than LONG bytes is merged on its own, as rounds over all
        of it would take the square of its length.
        """
        parts, together = [self._merged([])], []
        for w in words:
            if len(w) > LONG or len(together) == TOGETHER:
                parts.append(self._merged(together))
                together = []
            if len(w) > LONG:
                ids = self._merged_alone(w)
                parts.append((ids, np.array([len(ids)], np.int64)))
            else:
                together.append(w)
        parts.append(self._merged(together))
        ids, counts = zip(*parts)
        return np.concatenate(ids), np.concatenate(counts)

    def _merged_alone(self, word: bytes) -> np.ndarray:
        """exact() of one word: its pairs wait in a queue by rank and place, and each merge looks at its two neighbours."""
        raw = np.frombuffer(word, np.uint8)
        first = self.inner[raw]
        first[-1] = self.last[raw[-1]]
        n, ranks = len(first), self._ranks(first, np.zeros(len(first), np.int32))
        at = np.flatnonzero(ranks < NEVER)
        queue = (ranks[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(queue)
        symbols, alive, after, before = first.tolist(), bytearray(b"\1") * n, list(range(1, n + 1)), list(range(-1, n - 1))
        known, never = self.rank_of_pair, int(NEVER)

        def rank_of(a: int, b: int) -> int:
            pair = a << 32 | b
            found = known.get(pair)
            if found is None:
                found = known[pair] = int(self._pair_ranks(np.array([a]), np.array([b]))[0])
            return found

        while queue:
            top = heapq.heappop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if not alive[i] or j == n or rank_of(symbols[i], symbols[j]) != rank:
                continue
            symbols[i], alive[j] = int(self.merge_ids[rank]), 0
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                new = rank_of(symbols[i], symbols[k])
                if new < never:
                    heapq.heappush(queue, new << 32 | i)
            if h >= 0:
                new = rank_of(symbols[h], symbols[i])
                if new < never:
                    heapq.heappush(queue, new << 32 | h)
        return np.array(symbols, np.int32)[np.frombuffer(alive, np.uint8).astype(bool)]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """exact() of words that are merged together.

        Each round joins in every word all the pairs of its least rank that do not overlap, so the rounds are as many
        as the merges of the word with most of them.
        """
        counts = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words), dtype=np.int32), counts)
        ends = np.cumsum(counts)[counts > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        done_symbols, done_words = [], []
        rank = self._ranks(symbols, word)
        while len(symbols):
            new = np.append(True, word[1:] != word[:-1])
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            open_ = least < NEVER
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            hit = rank == least
            hit[1:] &= ~hit[:-1]
            at = np.flatnonzero(hit)
            symbols[at] = self.merge_ids[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            touched = np.zeros(len(symbols) + 1, bool)
            touched[at] = touched[at - 1] = True
            near = np.flatnonzero(touched[:-1])
            inside = near[:-1] if near[-1] == len(symbols) - 1 else near
            rank[near] = NEVER
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = self._pair_ranks(symbols[inside], symbols[inside + 1])
        if not done_symbols:
            return np.zeros(0, np.int32), counts
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), NEVER)
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._pair_ranks(symbols[:-1], symbols[1:]), NEVER)
        return rank

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their number by word, always taking the longest token that fits."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        end = np.repeat(np.cumsum(counts), counts)
        longest, token = np.zeros(n, np.int64), np.full(n, NONE)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            node = self.edges.get(node.astype(np.uint64) << np.uint64(8) | raw[at + depth].astype(np.uint64)).astype(np.int64)
            depth += 1
            on = node >= 0
            at, node = at[on], node[on]
            ids = self.token_at[node]
            full = ids >= 0
            longest[at[full]], token[at[full]] = depth, ids[full]
            more = at + depth < end[at]
            at, node = at[more], node[more]
        taken = np.zeros(n, bool)
        here = starts_of(counts)[counts > 0]
        stop = np.cumsum(counts)[counts > 0]
        while len(here):
            taken[here] = True
            here = here + longest[here]
            on = here < stop
            here, stop = here[on], stop[on]
        return token[taken], np.bincount(np.repeat(np.arange(len(words)), counts)[taken], minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the tokens a and b apart where they stand side by side, for whole arrays.

        Going back in time, the part of a that touches b and the part of b that touches a are taken apart, the later
        made first (b's on a tie, as merges of a rank go from left to right). The two parts exist together up to the
        time at which the earlier used one is used; a merge that joins them before that breaks the border. On a tie
        with a merge further left, that one comes first; on a tie with one further right, the border breaks.
        """
        ok = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_used, y_used = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            joined = self._pair_ranks(x, y)
            broken = (joined < x_used) & (joined <= y_used) & (joined < NEVER)
            ok[at[broken]] = False
            more = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, x_used, y_used = at[more], x[more], y[more], x_used[more], y_used[more]
            of_y = self.rank[y] >= self.rank[x]
            y_used[of_y] = self.rank[y[of_y]]
            y[of_y] = self.left[y[of_y]]
            x_used[~of_y] = self.rank[x[~of_y]]
            x[~of_y] = self.right[x[~of_y]]
        return ok

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids of exact merging, from proposals that pass the check and from merging the words that fail it.

        Also returns how many words failed. A word passes if every token stands alone as itself and every
        adjacent pair is compatible.
        """
        parts = [self._checked(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)] or [self._checked([])]
        ids, counts, failed = zip(*parts)
        return np.concatenate(ids), np.concatenate(counts), sum(failed)

    def _checked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        ids, counts = self.proposals(words)
        word = np.repeat(np.arange(len(words)), counts)
        bad = np.bincount(word, ~self.sound[ids], minlength=len(words)) > 0
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        pair, where = np.unique(ids[inner].astype(np.int64) << 32 | ids[inner + 1], return_inverse=True)
        fits = self.compatible((pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32))
        bad[word[inner[~fits[where]]]] = True
        if not bad.any():
            return ids, counts, 0
        failing = np.flatnonzero(bad)
        again, sizes = self.exact([words[i] for i in failing.tolist()])
        good = ~bad[word]
        ids = np.concatenate([ids[good], again])
        word = np.concatenate([word[good], np.repeat(failing, sizes)])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words)), len(failing)


class Runs:
    """A growing list of runs of ids, taken by number."""

    def __init__(self):
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first = np.append(self.first, len(self.ids) + starts_of(sizes))
        self.size = np.append(self.size, sizes)
        self.ids = np.append(self.ids, ids.astype(np.uint32))

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in a row, and the size of each."""
        sizes = self.size[runs]
        within = np.arange(int(sizes.sum())) - np.repeat(starts_of(sizes), sizes)
        return self.ids[np.repeat(self.first[runs], sizes) + within], sizes
