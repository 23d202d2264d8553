"""Cheapest edits of a conversation as a shortest path, found by the auction algorithm.

The lattice of n turns has nodes ``(turns consumed, state)``; the states follow what has been given
so far: nothing, a system turn, a user turn, an assistant turn. Arcs are the edits: K keeps a turn, R
reroles it, D deletes it, I inserts one; each state and letter has one arc at most, so letters name
the path. Every node has a price, and prices are kept feasible: ``price(i) <= cost(i, j) + price(j)`` for
every arc. A path grows from the start: if its last node's price is below the best of its arcs, the
price is raised to that and the path is contracted by the node, else it is extended along the best arc, until
it reaches the end. Costs are integers, each contraction raises a price by one at least, and no cycle
is free, so it ends. Then the start's price is the least cost, the prices are a dual solution, and every
cheapest path consists of tight arcs (``price(i) == cost + price(j)``): among those that lead to
the end the path of least letters is traced.

A long conversation is cut into segments. Arcs that insert belong to the turn after them (those after the
last turn to a segment without turns), so each segment's letters end with one that consumes its last turn
and no segment's letters begin with another's. ``distances`` condenses a segment to its costs between states;
``boundary_prices`` runs the same auction over the segments.
"""

from __future__ import annotations

from functools import lru_cache

#: Nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of that initial; what comes next is always one role, or a system turn at the start.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INF = 1 << 60

#: A turn's code: its role's initial (x: none of s, u, a) in upper case if it must go; with ``+`` if it is truncated.
Arc = tuple[str, int, int, int]  # letter, cost, layers ahead, state


def spoken(state: int) -> str:
    """The initial of the turn that R and I give in a state."""
    return "a" if state == USER else "u"


@lru_cache(maxsize=4096)
def turn_arcs(code: str, state: int) -> tuple[Arc, ...]:
    """Arcs of a node before a turn, in order of their letters."""
    initial, extra = code[0], TRUNCATED if code.endswith("+") else 0
    after = NEXT[state][spoken(state)]
    out: list[Arc] = [("D", DELETE, 1, state), ("I", INSERT, 0, after)]
    if not initial.isupper():
        if initial in NEXT[state]:
            out.append(("K", KEEP + extra, 1, NEXT[state][initial]))
        out.append(("R", REROLE + extra, 1, after))
    return tuple(out)


def end_arcs(state: int) -> tuple[Arc, ...]:
    """Arcs of a node after the last turn: the end is one layer ahead, in state 0."""
    insert: tuple[Arc, ...] = (("I", INSERT, 0, NEXT[state][spoken(state)]),)
    return (*insert, *((("", 0, 1, 0),) if state in FINAL else ()))


class Lattice:
    """Layers of up to four nodes; ``layers[i][state]`` are the arcs of a node. The end is the layer after
    the last, entered at state ``e`` for the additional cost ``exits[e]``."""

    def __init__(self, layers: list[list[tuple[Arc, ...]]], exits: dict[int, int]):
        self.layers, self.exits, self.n = layers, exits, len(layers)
        # Feasible first prices: what the layers ahead cost at least.
        least = min(exits.values(), default=INF)
        self.price = [[least] * 4 for _ in range(self.n + 1)]
        for i in range(self.n - 1, -1, -1):
            ahead = [a[1] for arcs in layers[i] for a in arcs if a[2]]
            least = min(INF, least + min(ahead, default=INF))
            self.price[i] = [least] * 4
        self.price[self.n] = [exits.get(e, INF) for e in range(4)]
        # Nodes without any way to the end would raise each other's prices for ever.
        for i, reach in enumerate(self._reached(lambda i, s, arc: True)[:-1]):
            self.price[i] = [p if r else INF for p, r in zip(self.price[i], reach)]
        self.settled = [[p >= INF for p in layer] for layer in self.price[:-1]] + [[True] * 4]

    def auction(self, state: int, layer: int = 0) -> int:
        """The least cost from a node to the end; prices are raised on the way.

        Origins go from the last layer back: a path that meets a node whose way to the end is known is done, so
        the work grows with the turns and not with their square.
        """
        for i in range(self.n - 1, layer, -1):
            for s in range(4):
                if not self.settled[i][s]:
                    self._grow(i, s)
        if layer < self.n and not self.settled[layer][state]:
            self._grow(layer, state)
        return self.price[layer][state]

    def _grow(self, layer: int, state: int) -> None:
        price, layers, settled = self.price, self.layers, self.settled
        path = [(layer, state)]
        while True:
            i, s = path[-1]
            if settled[i][s] and price[i][s] < INF:
                for i, s in path:  # tight arcs all the way
                    settled[i][s] = True
                return
            best, to = INF, None
            for _, cost, ahead, t in layers[i][s]:
                if cost + price[i + ahead][t] < best:
                    best, to = cost + price[i + ahead][t], (i + ahead, t)
            if price[i][s] < best:  # raise the price, contract the path
                price[i][s] = best
                if len(path) > 1:
                    path.pop()
            elif to is None:  # no way to the end
                settled[i][s] = True
                path.pop()
                if not path:
                    return
            else:  # extend it
                path.append(to)

    def _reached(self, passes) -> list[list[bool]]:
        """The nodes from which arcs that pass lead to the end."""
        out = [[False] * 4 for _ in range(self.n)] + [[self.exits.get(e, INF) < INF for e in range(4)]]
        for i in range(self.n - 1, -1, -1):
            for _ in range(3):  # inserts stay in a layer
                for s in range(4):
                    out[i][s] = out[i][s] or any(out[i + a[2]][a[3]] and passes(i, s, a) for a in self.layers[i][s])
        return out

    def alive(self) -> list[list[bool]]:
        """The nodes from which tight arcs lead to the end: their prices are exact distances."""
        return self._reached(self.tight)

    def tight(self, i: int, s: int, arc: Arc) -> bool:
        return self.price[i][s] < INF and self.price[i][s] == arc[1] + self.price[i + arc[2]][arc[3]]

    def trace(self, state: int) -> tuple[str, int]:
        """The letters of the cheapest path that are least in ASCII order, and the state it ends in."""
        alive, letters, i, s = self.alive(), [], 0, state
        while i < self.n:
            letter, _, ahead, s_next = min(a for a in self.layers[i][s] if self.tight(i, s, a) and alive[i + a[2]][a[3]])
            letters.append(letter)
            i, s = i + ahead, s_next
        return "".join(letters), s


def turns_lattice(codes: tuple[str, ...], exits: dict[int, int]) -> Lattice:
    return Lattice([[turn_arcs(c, s) for s in range(4)] for c in codes], exits)


def whole_lattice(codes: tuple[str, ...]) -> Lattice:
    """All turns, and what may be inserted after the last."""
    layers = [[turn_arcs(c, s) for s in range(4)] for c in codes] + [[end_arcs(s) for s in range(4)]]
    return Lattice(layers, {0: 0})


@lru_cache(maxsize=1 << 16)
def repair(codes: tuple[str, ...]) -> tuple[int, str]:
    """Least cost and letters of a whole conversation."""
    lattice = whole_lattice(codes)
    cost = lattice.auction(START)
    return cost, lattice.trace(START)[0]


@lru_cache(maxsize=1 << 12)
def distances(codes: tuple[str, ...]) -> tuple[int, ...]:
    """Costs of a segment between its 4 x 4 states (``INF``: no path)."""
    out = []
    for e in range(4):
        lattice = turns_lattice(codes, {e: 0})
        out.append([lattice.auction(s) for s in range(4)])
    return tuple(out[e][s] for s in range(4) for e in range(4))


def boundary_prices(segments: list[tuple[int, ...]]) -> list[list[int]]:
    """For each boundary after a segment: the least cost from each state to the end of the conversation
    (``INF``: not on a cheapest way)."""
    layers = [[tuple(("", d[4 * s + e], 1, e) for e in range(4) if d[4 * s + e] < INF) for s in range(4)]
              for d in segments] + [[end_arcs(s) for s in range(4)]]
    lattice = Lattice(layers, {0: 0})
    lattice.auction(START)
    alive = lattice.alive()
    return [[lattice.price[i][s] if alive[i][s] else INF for s in range(4)] for i in range(1, len(segments) + 1)]


@lru_cache(maxsize=1 << 12)
def segment_traces(codes: tuple[str, ...], exits: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state that a segment may be entered in its letters and the state after it (-1: no way);
    ``exits`` are the boundary's prices."""
    lattice = turns_lattice(codes, {e: p for e, p in enumerate(exits) if p < INF})
    return tuple(lattice.trace(s) if lattice.auction(s) < INF else ("", -1) for s in range(4))


def end_trace(state: int) -> str:
    """What is inserted after the last turn."""
    lattice = Lattice([[end_arcs(s) for s in range(4)]], {0: 0})
    lattice.auction(state)
    return lattice.trace(state)[0]


def repaired(letters: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int]:
    """The repaired turns as ``role:text`` and the state after them."""
    names, out, at = {"u": "user", "a": "assistant"}, [], 0
    for x in letters:
        if x == "D":
            at += 1
            continue
        if x == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = NEXT[state][roles[at][:1]]
        else:
            out.append(f"{names[spoken(state)]}:{texts[at] if x == 'R' else ''}")
            state = NEXT[state][spoken(state)]
        at += x != "I"
    return out, state
