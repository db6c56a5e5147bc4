"""Small weighted finite-state transducers over symbols, and their composition."""

from __future__ import annotations

from dataclasses import dataclass, field

ANY = "*"  # an arc for all symbols that have none of their own; as output: the symbol that was read


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (next state, output, weight). State 0 is the first; weights of a path add up."""

    arcs: dict[tuple[object, str], tuple[object, str, float]] = field(default_factory=dict)

    def arc(self, state, symbol: str, to, output: str = ANY, weight: float = 0.0) -> Transducer:
        self.arcs[state, symbol] = (to, output, weight)
        return self

    def step(self, state, symbol: str) -> tuple[object, str, float]:
        to, output, weight = self.arcs.get((state, symbol)) or self.arcs[state, ANY]
        return to, symbol if output == ANY else output, weight


def compose(parts: list[Transducer], alphabet: list[str]) -> Transducer:
    """One transducer that does what the parts do one after the other, for the states that ``alphabet`` can reach."""
    first = tuple(0 for _ in parts)
    number, todo, out = {first: 0}, [first], Transducer()
    while todo:
        states = todo.pop()
        for symbol in alphabet:
            said, total, nexts = symbol, 0.0, []
            for part, state in zip(parts, states):
                to, said, weight = part.step(state, said)
                nexts.append(to)
                total += weight
            to = tuple(nexts)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            out.arc(number[states], symbol, number[to], said, total)
    return out
