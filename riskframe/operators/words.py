"""Many words looked for in a text at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class State(dict):
    """What the last bytes of a text are the longest start of: byte -> next state, learned as it is met.

    `fail` is the state of the longest shorter end of these bytes, `end` the longest state among this one and those that
    is a whole word, `names` what this word stands for.
    """

    __slots__ = ("fail", "end", "names")
    __hash__, __eq__ = object.__hash__, object.__eq__

    def __init__(self) -> None:
        self.fail, self.end, self.names = None, None, []

    def follow(self, byte: int) -> State:
        state = self
        while byte not in state and state.fail is not None:
            state = state.fail
        return state.get(byte, state)

    def __missing__(self, byte: int) -> State:
        self[byte] = found = self.follow(byte)
        return found


def automaton(named: Iterable[tuple[bytes, str]]) -> State:
    """The start of an Aho-Corasick automaton for (word, name); a word may have several names."""
    start = State()
    for word, name in named:
        state = start
        for byte in word:
            if byte not in state:
                state[byte] = State()
            state = state[byte]
        state.names.append(name)
        state.end = state
    waiting = deque(start.values())
    for state in waiting:
        state.fail = start
    while waiting:
        state = waiting.popleft()
        for byte, longer in state.items():
            longer.fail = state.fail.follow(byte)
            if longer.end is None:
                longer.end = longer.fail.end
            waiting.append(longer)
    return start


def names_in(start: State, text: bytes) -> list[str]:
    """The names of all words that stand anywhere in `text`, in one pass over it."""
    state, seen = start, set()
    meet = seen.add
    for byte in text:
        state = state[byte]
        meet(state)
    ends, names = set(), []
    for state in seen:
        end = state.end
        while end is not None and end not in ends:
            ends.add(end)
            names += end.names
            end = end.fail.end
    return names
