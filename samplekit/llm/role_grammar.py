"""A weighted generalised LR parser over the roles of a conversation: small, and called row by row inside Spark tasks.

An SLR automaton is built of the grammar. The frontier of the parse maps stacks of automaton states to the cheapest way to reach
them; stacks are tuples that share no position, so ways whose stack tops are equal meet, and the least (cost, audit) stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: The grammar (s?(ua)+)?, left recursive so that stacks stay short; costs; roles that may be inserted or given.
ROLES = {"C": ((), ("s", "P"), ("P",)), "P": (("P", "u", "a"), ("u", "a"))}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GIVEN = {"u": "user", "a": "assistant"}

Stack = tuple[int, ...]
Way = tuple[int, "Way | None", str, str, int]  # cost, the way before, the edit since, the role initial that it gives ("-": none), number of edits
START: Way = (0, None, "", "", 0)


class Automaton:
    """SLR tables of a grammar, with all of its actions kept where they conflict."""

    def __init__(self, grammar: dict[str, tuple[tuple[str, ...], ...]], start: str) -> None:
        self.grammar = {"": ((start,),), **grammar}
        follow = self._follow()
        states: dict[frozenset, int] = {self._closure({("", (start,), 0)}): 0}
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: list[list[tuple[str, int, frozenset[str]]]] = []
        for items in (queue := list(states)):
            at = states[items]
            self.reduce.append([(left, len(right), follow[left]) for left, right, dot in sorted(items) if dot == len(right)])
            for symbol in sorted({right[dot] for _, right, dot in items if dot < len(right)}):
                further = self._closure({(left, right, dot + 1) for left, right, dot in items if dot < len(right) and right[dot] == symbol})
                if further not in states:
                    states[further] = len(states)
                    queue.append(further)
                self.goto[at, symbol] = states[further]
        self.terminals = sorted({x for rights in grammar.values() for right in rights for x in right if x not in grammar})
        self._shifted: dict[tuple[Stack, str], tuple[Stack, ...]] = {}
        self._accepted: dict[Stack, bool] = {}

    def _closure(self, items: set) -> frozenset:
        queue = list(items)
        for _, right, dot in queue:
            for further in self.grammar.get(right[dot], ()) if dot < len(right) else ():
                if (item := (right[dot], further, 0)) not in items:
                    items.add(item)
                    queue.append(item)
        return frozenset(items)

    def _follow(self) -> dict[str, frozenset[str]]:
        empty, first, follow = set(), {n: set() for n in self.grammar}, {n: set() for n in self.grammar}
        follow[""] = {"$"}
        starts = lambda x: first[x] if x in first else {x}
        for _ in range(sum(map(len, self.grammar.values())) * 3 + 3):  # longer than any chain of inclusions
            for left, rights in self.grammar.items():
                for right in rights:
                    for k, x in enumerate(right):
                        if all(y in empty for y in right[:k]):
                            first[left] |= starts(x)
                        if x in follow:
                            rest = k + 1
                            while rest < len(right) and right[rest] in empty:
                                follow[x] |= starts(right[rest])
                                rest += 1
                            follow[x] |= starts(right[rest]) if rest < len(right) else follow[left]
                    if all(y in empty for y in right):
                        empty.add(left)
        return {n: frozenset(f) for n, f in follow.items()}

    def _reduced(self, stack: Stack, ahead: str | None) -> Iterator[Stack]:
        """The stack, and those that its reductions lead to; without a symbol ahead only where nothing else could be done in its state."""
        yield stack
        own = self.reduce[stack[-1]]
        if ahead is None and (len(own) != 1 or any(state == stack[-1] for state, _ in self.goto)):
            return
        for left, size, follow in own:
            if left and (ahead is None or ahead in follow):
                below = stack[: len(stack) - size]
                yield from self._reduced((*below, self.goto[below[-1], left]), ahead)

    def shifts(self, stack: Stack, terminal: str) -> tuple[Stack, ...]:
        """Stacks after a terminal."""
        if (found := self._shifted.get((stack, terminal))) is None:
            moved = [(*s, self.goto[s[-1], terminal]) for s in self._reduced(stack, terminal) if (s[-1], terminal) in self.goto]
            found = self._shifted[stack, terminal] = tuple(dict.fromkeys([*self._reduced(m, None)][-1] for m in moved))
        return found

    def accepts(self, stack: Stack) -> bool:
        if stack not in self._accepted:
            self._accepted[stack] = any(not left for s in self._reduced(stack, "$") for left, _, _ in self.reduce[s[-1]])
        return self._accepted[stack]

    def stacks(self, most: int = 64) -> list[Stack]:
        """All stacks that any input leads to; an error where the grammar lets them grow without end."""
        queue = [(0,)]
        for stack in queue:
            for further in (s for t in self.terminals for s in self.shifts(stack, t)):
                if further not in queue:
                    queue.append(further)
            if len(queue) > most:
                raise ValueError("the grammar must be left recursive, so that its stacks are bounded")
        return queue


def _since(way: Way, other: Way) -> tuple[str, str]:
    """Edits of both since they last were one way."""
    own, others = [], []
    while way is not other:
        if way[4] >= other[4]:
            own.append(way[2])
            way = way[1]
        else:
            others.append(other[2])
            other = other[1]
    return "".join(reversed(own)), "".join(reversed(others))


def better(way: Way, other: Way) -> bool:
    """Whether way has the lower cost or, at the same cost, the audit that comes first. Ways of one cost over the same rows are never prefixes of each other."""
    if way[0] != other[0]:
        return way[0] < other[0]
    own, others = _since(way, other)
    return own < others


Frontier = dict[Stack, Way]


def offer(frontier: Frontier, stack: Stack, way: Way) -> bool:
    if stack in frontier and not better(way, frontier[stack]):
        return False
    frontier[stack] = way
    return True


def with_inserts(grammar: Automaton, frontier: Frontier) -> Frontier:
    """The frontier, and what inserted rows lead to."""
    queue = list(frontier)
    for stack in queue:
        cost, *_ = way = frontier[stack]
        for role in GIVEN:
            for further in grammar.shifts(stack, role):
                if offer(frontier, further, (cost + INSERT, way, "I", role, way[4] + 1)):
                    queue.append(further)
    return frontier


def step(grammar: Automaton, frontier: Frontier, initial: str, must_go: bool, truncated: bool) -> Frontier:
    """The frontier after a row, by deleting, keeping or reroling it."""
    out: Frontier = {}
    extra = TRUNCATED if truncated else 0
    for stack, way in frontier.items():
        cost, _, _, _, edits = way
        offer(out, stack, (cost + DELETE, way, "D", "-", edits + 1))
        if must_go:
            continue
        for further in grammar.shifts(stack, initial) if initial in grammar.terminals else ():
            offer(out, further, (cost + KEEP + extra, way, "K", initial, edits + 1))
        for role in GIVEN:
            for further in grammar.shifts(stack, role):
                offer(out, further, (cost + REROLE + extra, way, "R", role, edits + 1))
    return with_inserts(grammar, out)


def cheapest(grammar: Automaton, frontier: Frontier) -> Way:
    """The best way of those whose stack the grammar accepts."""
    best = None
    for stack, way in frontier.items():
        if grammar.accepts(stack) and (best is None or better(way, best)):
            best = way
    if best is None:
        raise ValueError("no repair leads to the grammar")
    return best


def parse(grammar: Automaton, rows: Iterable[tuple[str, bool, bool]], entry: Stack = (0,)) -> Frontier:
    """The frontier after rows of (role initial, must go, truncated), from one stack."""
    frontier = with_inserts(grammar, {entry: START})
    for row in rows:
        frontier = step(grammar, frontier, *row)
    return frontier


def follow_on(frontier: Frontier, ways: Iterable[tuple[Stack, Stack, int, str, str]]) -> Frontier:
    """The frontier after a whole segment, of what leads through it: entry, leaves, cost, edits and the initials that they give."""
    out: Frontier = {}
    for entry, leaves, cost, edits, gives in ways:
        if entry in frontier:
            before = frontier[entry]
            offer(out, leaves, (before[0] + cost, before, edits, gives, before[4] + 1))
    return out


def pieces(way: Way) -> list[tuple[str, str]]:
    """Edits and given initials of each step of a way, in order."""
    out = []
    at: Way | None = way
    while at is not None and at[1] is not None:
        out.append((at[2], at[3]))
        at = at[1]
    return out[::-1]
