"""The penalty box of both sides, event after event; plain Python that travels to workers as it is."""

from __future__ import annotations

from collections import deque


class Box:
    """The penalty box of one side: minors wait in a queue (the oldest call is let out by a goal), longer penalties only run out."""

    __slots__ = ("minors", "longer")

    def __init__(self) -> None:
        self.minors: deque[int] = deque()
        self.longer: list[int] = []

    def sit(self, until: int, minor: bool) -> None:
        (self.minors if minor else self.longer).append(until)

    def let_out(self) -> None:
        if self.minors:
            self.minors.popleft()

    def open_doors(self, now: int) -> None:
        self.minors = deque(t for t in self.minors if t > now)
        self.longer = [t for t in self.longer if t > now]

    def report(self, clock: int) -> tuple[int, int]:
        ends = [*self.minors, *self.longer]
        return len(ends), sum(max(0, t - clock) for t in ends)


def boxes() -> dict[str, Box]:
    return {"home": Box(), "away": Box()}


def after_event(both: dict[str, Box], row: tuple) -> tuple:
    """State of both boxes after one event of a chain."""
    game, _, index, kind, side, edge, second, minutes = row
    if second is not None:
        for box in both.values():
            box.open_doors(second)
    if side in both:
        if kind == "penalty" and minutes and second is not None:
            both[side].sit(second + int(minutes * 60), minutes <= 2)
        elif kind == "goal" and edge == side:
            both["away" if side == "home" else "home"].let_out()
    (n_home, left_home), (n_away, left_away) = (both[s].report(second or 0) for s in ("home", "away"))
    return game, index, n_home, n_away, left_home, left_away
