"""Segmentation lattices of many words at once, as numpy arrays.

A SentencePiece text is cut before every blank that follows another character; no piece
reaches over such a cut (``Pieces`` verifies that of its vocabulary), so a text's
lattice is the chain of its words' lattices and equal words share one.
"""

from __future__ import annotations

import numpy as np

from tessera.llm import textscan

BLANK = "▁"
#: Characters from its end on up to which a word's sums need no exponents.
SCALED = 24
_LEN = np.uint64(0xDA942042E4DD58B5)


class Pieces:
    """A SentencePiece vocabulary: the log-probability of each piece, and the trie of all pieces.

    The scores of a unigram model are log-probabilities. Those of a BPE model are merge
    ranks: a piece then has the weight ``1 / (rank + 3)``, about the frequency of the
    rank's pieces in the corpus they were counted in; pieces without rank (runs of
    blanks) and byte pieces have the least weight.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(BLANK in names[i].lstrip(BLANK) for i in usable):
            raise ValueError("a piece has a blank inside: words are not independent")
        scores = {i: sp.get_score(i) for i in usable}
        ranked = min((s for s in scores.values() if s > -1e8), default=0.0) < -1000
        least = -np.log(n + 3.0) if ranked else min(scores.values(), default=0.0) - 10.0
        self.log_p = np.full(n, least)
        for i, s in scores.items():
            if s > -1e8:
                self.log_p[i] = -np.log(-s + 3.0) if ranked else s
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        #: Weight of each piece, and as the last that of a byte.
        self.weight = np.exp(np.append(self.log_p, least))
        self.unknown = int(sp.unk_id())
        self.byte_fallback = bool((self.byte_ids >= 0).all())
        # Bytes of every piece, for decoding (a byte piece is its byte, control pieces nothing).
        surface = [b""] * n
        for i in usable:
            surface[i] = names[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_first = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        # The trie of all pieces: node 0 is the root, ``node_piece`` the piece that ends at a node.
        self.longest = max((len(names[i]) for i in usable), default=1)
        nodes, steps = {"": 0}, {}
        for i in usable:
            text = names[i].replace(BLANK, " ")
            for j in range(1, len(text) + 1):
                node = nodes.setdefault(text[:j], len(nodes))
                steps[nodes[text[: j - 1]], ord(text[j - 1])] = node
        self.node_piece = np.full(len(nodes), -1, np.int32)
        for i in usable:
            self.node_piece[nodes[names[i].replace(BLANK, " ")]] = i
        # What a piece's weight is for one of its characters, typically: keeps sums near 1.
        self.per_char = np.exp(2.0 * np.arange(self.longest + 1))
        self.bits = np.uint64(64 - max(10, int(len(steps) * 4).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.step_key, self.step_node = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys = np.array([(n << 21) | c for n, c in steps], np.int64)
        for key, at, node in zip(keys.tolist(), self._slot(keys).tolist(), steps.values()):
            while self.step_key[at] >= 0:
                at = (at + 1) % size
            self.step_key[at], self.step_node[at] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _LEN) >> self.bits).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that a character leads to from each node, -1 for none."""
        key = (node.astype(np.int64) << 21) | code
        at = self._slot(key)
        there = self.step_key[at]
        out = np.where(there == key, self.step_node[at], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there >= 0))
        at, key = at[todo], key[todo]
        while len(todo):  # the next slots, until the key or an empty one
            at = (at + 1) % len(self.step_key)
            there = self.step_key[at]
            same = there == key
            out[todo[same]] = self.step_node[at[same]]
            on = ~same & (there >= 0)
            todo, at, key = todo[on], at[on], key[on]
        return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = textscan._POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return sums


_BYTES = textscan._byte_values()


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = textscan._POWERS.get(len(sums))
    return textscan.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _LEN)


def word_begins(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where words begin: at texts, and at blanks after another character."""
    begins = np.zeros(len(data) + 1, bool)
    blank = data == 32
    begins[1 : len(data)] = blank[1:] & ~blank[:-1]
    begins[offs] = True
    return np.flatnonzero(begins[: len(data)])


class Words:
    """Lattices of words given by their bytes: ``own``, where each begins and ends.

    State = a place between characters of a word. ``source, target, piece, p`` of each
    edge; the ``count[s]`` edges from ``first[s]`` on are those of state s. ``p`` is the
    probability of the edge among its source's, weighted by all that can follow, so a
    word's edges multiply to its segmentation's probability; ``upto`` adds them up, in 2^-53.
    ``start`` is the first state of each word.
    """

    def __init__(self, own: np.ndarray, begin: np.ndarray, end: np.ndarray, pieces: Pieces):
        lead = (own & 0xC0) != 0x80
        chars = np.add.reduceat(lead.astype(np.int64), begin) if len(begin) else begin
        state0 = np.concatenate(([0], np.cumsum(chars + 1))).astype(np.int32)
        n_states = int(state0[-1])
        # The byte at which each state stands; a word's last state stands at its end.
        self.is_end = np.zeros(n_states, bool)
        self.is_end[state0[1:] - 1] = True
        byte_at = np.zeros(n_states, np.int32)
        byte_at[~self.is_end] = np.flatnonzero(lead)
        byte_at[state0[1:] - 1] = end
        last = np.repeat(state0[1:] - 1, chars + 1)  # the end state of each state's word
        self.start = state0[:-1]
        self.pieces = pieces
        nodes = np.flatnonzero(~self.is_end).astype(np.int32)
        code = np.zeros(n_states, np.uint32)
        code[nodes] = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
        code[state0[1:] - 1] = 1 << 20 | 0xFFFFF  # no character: no way leads past a word's end
        count = np.zeros(n_states, np.int32)
        made = []
        live, at = nodes, np.zeros(len(nodes), np.int32)
        for n in range(1, pieces.longest + 1):
            at = pieces.step(at, code[live + (n - 1)])
            piece = pieces.node_piece[at]
            hit = np.flatnonzero((at >= 0) & (piece >= 0))
            src = live[hit]
            made.append((src, n, piece[hit], count[src]))
            count[src] += 1
            if n == 1:
                lone = live[(at < 0) | (piece < 0)]  # no piece for the character: its bytes
                made.append((lone, 1, -1, count[lone]))
                count[lone] += 1
            on = np.flatnonzero(at >= 0)
            live, at = live[on], at[on]
            if not len(live):
                break
        # Edges in order of how far their source is from its word's end: sums run that way.
        away = last[nodes] - nodes
        most = int(away.max()) if len(away) else 0
        order = np.argsort(away.astype(np.uint16) if most < 1 << 16 else away, kind="stable")
        nodes, away = nodes[order], away[order]
        self.count = count
        upto = np.cumsum(count[nodes])
        self.first = np.zeros(n_states, np.int32)
        self.first[nodes] = upto - count[nodes]
        total = int(upto[-1]) if len(upto) else 0
        length, self.piece = np.zeros(total, np.int32), np.zeros(total, np.int32)
        behind = self.first + count - 1
        for src, n, piece, rank in made:
            i = behind[src] - rank  # the longest piece first: it is mostly the likeliest
            length[i], self.piece[i] = n, piece
        self.source = np.repeat(nodes, count[nodes])
        self.target = self.source + length
        self.byte_at, self.own = byte_at, own
        weight = pieces.weight[self.piece]  # of pieces; the last is that of a byte
        lone = np.flatnonzero(self.piece < 0)
        if len(lone):
            weight[lone] **= byte_at[self.target[lone]] - byte_at[self.source[lone]]
        # A factor for each character is the same for all ways through a word.
        weight *= pieces.per_char[length]
        self._weigh(weight, nodes, away, most)

    def _weigh(self, weight: np.ndarray, nodes: np.ndarray, away: np.ndarray, most: int) -> None:
        """Sums over all ways to the end, from the ends of words backwards, and ``p`` from them.

        Sums far from the end are numbers with an exponent of their own: words of any length have them.
        """
        n_states = len(self.is_end)
        beta, power = np.ones(n_states), np.zeros(n_states, np.int32)
        cuts = np.searchsorted(away, np.arange(1, most + 2)).tolist()
        begins = np.append(self.first[nodes], len(weight))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            mine, x, y = nodes[a:b], int(begins[a]), int(begins[b])
            to, begin = self.target[x:y], begins[a:b] - x
            if away[a] > SCALED:  # words so long that their sums may leave the range of numbers
                top = np.maximum.reduceat(power[to], begin)
                v = weight[x:y] * np.ldexp(beta[to], power[to] - np.repeat(top, np.diff(begins[a : b + 1])))
                sums, shift = np.frexp(np.add.reduceat(v, begin))
                beta[mine], power[mine] = sums, shift + top
            else:
                beta[mine] = np.add.reduceat(weight[x:y] * beta[to], begin)
        n = self.count[nodes]
        self.p = weight * beta[self.target] * np.repeat(1.0 / beta[nodes], n)
        if most > SCALED:
            self.p = np.ldexp(self.p, power[self.target] - np.repeat(power[nodes], n))
        # Whole numbers, whose sums modulo 2^64 do not depend on the words before.
        sums = np.cumsum((self.p * 2.0**53).astype(np.uint64))
        before = np.concatenate((np.zeros(1, np.uint64), sums))[begins[:-1]]
        self.upto = sums - np.repeat(before, n)

    def n_bytes(self, edges: np.ndarray) -> np.ndarray:
        return self.byte_at[self.target[edges]] - self.byte_at[self.source[edges]]

    def choose(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each state, by its probabilities and a uniform number below 2^53."""
        at = self.first[state]
        end = at + self.count[state] - 1
        on = np.flatnonzero((u >= self.upto[at]) & (at < end))
        while len(on):
            at[on] += 1
            on = on[(u[on] >= self.upto[at[on]]) & (at[on] < end[on])]
        return at


class Lattice(Words):
    """Lattices of all distinct words of a run of texts: ``row`` and ``start`` (the first state) of
    every word occurrence, in text order."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, pieces: Pieces):
        begin = word_begins(data, offs)
        end = np.append(begin[1:], len(data))
        hashes = span_hashes(prefix_sums(data), begin, end)
        _, firsts, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = (end - begin)[firsts]
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size) + np.repeat(begin[firsts], size)
        super().__init__(data[at], upto - size, upto, pieces)
        self.row = np.searchsorted(offs, begin, side="right") - 1
        self.start = self.start[which]
