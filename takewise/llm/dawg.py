"""Cheapest edits of conversations, worked out from the end on an automaton whose nodes are the distinct suffixes."""

from __future__ import annotations

from dataclasses import dataclass

#: Grammar s?(ua)+ or nothing: 0 at the start, 1 after s, 2 after u, 3 after a; only 0 and 3 may end.
STATES = 4
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one initial other than s that each state lets follow, and the state after it.
_NEXT = tuple(next((i, q) for i, q in after.items() if i != "s") for after in _AFTER)
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class SuffixAutomaton:
    """Signatures share their suffixes: a node is a symbol and the node of what follows it, made once.

    A symbol is the initial of a role (s, u, a, or o for others), a capital if the text is truncated, or x for a row that
    has to go. Each node knows, for each state of the grammar, the cost of what is to come and the first edit of the
    cheapest way, the least in ASCII among equal ones. The four edits of a state begin with different letters, so the
    first letter decides ties and the rest is the best of the state that follows.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs, self.register = costs, {}
        self.symbol, self.next, self.cost, self.edit = [""], [0], [], []
        self._settle([(0, ""), None, None, (0, "")])

    def _settle(self, found: list[tuple[int, str] | None]) -> None:
        for _ in range(STATES):  # an insertion leads to another state of the same node; three in a row never pay
            for q in range(STATES):
                there = found[_NEXT[q][1]]
                if there is not None and (found[q] is None or (there[0] + self.costs.insert, "I") < found[q]):
                    found[q] = (there[0] + self.costs.insert, "I")
        self.cost.append([c for c, _ in found])
        self.edit.append([e for _, e in found])

    def node(self, signature: str) -> int:
        """The node of a signature, with those of its suffixes."""
        at = 0
        for symbol in reversed(signature):
            key = (symbol, at)
            known = self.register.get(key)
            if known is None:
                known = self.register[key] = len(self.symbol)
                self.symbol.append(symbol)
                self.next.append(at)
                self._add(symbol, self.cost[at])
            at = known
        return at

    def _add(self, symbol: str, after: list[int]) -> None:
        found: list[tuple[int, str] | None] = [(c + self.costs.delete, "D") for c in after]
        if symbol != "x":
            extra, initial = (self.costs.truncated if symbol.isupper() else 0), symbol.lower()
            for q in range(STATES):
                keep = _AFTER[q].get(initial)
                if keep is not None:
                    found[q] = min(found[q], (after[keep] + extra, "K"))
                found[q] = min(found[q], (after[_NEXT[q][1]] + extra + self.costs.rerole, "R"))
        self._settle(found)

    def best(self, signature: str) -> tuple[int, str]:
        """The least cost and the edits that bring it."""
        at, state, out = self.node(signature), 0, []
        total = self.cost[at][0]
        while True:
            edit = self.edit[at][state]
            if not edit:
                return total, "".join(out)
            out.append(edit)
            state = follow(state, edit, self.symbol[at].lower())
            if edit != "I":
                at = self.next[at]


def follow(state: int, edit: str, initial: str) -> int:
    """The state after an edit of a row with that initial."""
    if edit == "D":
        return state
    return _AFTER[state][initial] if edit == "K" else _NEXT[state][1]


def needed(state: int) -> str:
    """The role that an insertion or a change of role brings in a state."""
    return ROLES[_NEXT[state][0]]
