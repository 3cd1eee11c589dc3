"""A view's whole state as a compact text and back.

Layout, big-endian: version, flags, sort column (0: none), direction, 32-bit mask of collapsed groups; then length-prefixed
bitsets of hidden columns and hidden rows; then counted filters (column, UTF-8 text) and counted selection rows (row id,
bitset of columns). The bytes are URL-safe base64 without padding.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

VERSION = 1


@dataclass
class ViewState:
    """Sort, projection, suppression, filters and selection of a grid, all by stable ids."""

    sort_column: int | None = None
    descending: bool = False
    collapsed_groups: set[int] = field(default_factory=set)
    hidden_columns: set[int] = field(default_factory=set)
    hidden_rows: set[int] = field(default_factory=set)
    filters: dict[int, str] = field(default_factory=dict)
    selected: set[tuple[int, int]] = field(default_factory=set)

    def next_sort(self, column: int) -> None:
        """Ascending, then descending, then none."""
        if self.sort_column != column:
            self.sort_column, self.descending = column, False
        elif not self.descending:
            self.descending = True
        else:
            self.sort_column, self.descending = None, False

    def set_filter(self, column: int, text: str) -> None:
        """A blank text removes the filter."""
        if text.strip():
            self.filters[column] = text.strip()
        else:
            self.filters.pop(column, None)

    def show_filters(self, on: bool) -> None:
        """Hiding the filter row clears all filters."""
        if not on:
            self.filters.clear()

    def hide_columns(self, columns: Iterable[int]) -> None:
        """Hidden columns leave the selection; their filters stay in force."""
        gone = set(columns)
        self.hidden_columns |= gone
        self.selected = {(r, c) for r, c in self.selected if c not in gone}

    def hide_rows(self, rows: Iterable[int]) -> None:
        gone = set(rows)
        self.hidden_rows |= gone
        self.selected = {(r, c) for r, c in self.selected if r not in gone}

    def reset(self) -> bool:
        """Back to the empty state; tells whether any filter was set."""
        on = bool(self.filters)
        self.__dict__.update(ViewState().__dict__)
        return on


def bitset(ids: Iterable[int]) -> bytes:
    """Lowest id in the lowest bit of the first byte; no ids give no bytes."""
    n = 0
    for i in ids:
        n |= 1 << i
    return n.to_bytes((n.bit_length() + 7) // 8, "little")


def ids_of(bits: bytes) -> set[int]:
    return {8 * k + i for k, byte in enumerate(bits) if byte for i in range(8) if byte >> i & 1}


def _sized(data: bytes) -> bytes:
    return struct.pack(">H", len(data)) + data


def encode(state: ViewState) -> str:
    """Groups beyond 31 have no bit and are left out; sort column 0 means none."""
    mask = sum(1 << g for g in state.collapsed_groups if 0 <= g <= 31)
    out = [struct.pack(">BBHBI", VERSION, 0, state.sort_column or 0, int(state.descending), mask), _sized(bitset(state.hidden_columns)), _sized(bitset(state.hidden_rows)), struct.pack(">H", len(state.filters))]
    out += [struct.pack(">H", c) + _sized(t.encode()) for c, t in state.filters.items()]
    rows: dict[int, set[int]] = {}
    for r, c in sorted(state.selected):
        rows.setdefault(r, set()).add(c)
    out.append(struct.pack(">H", len(rows)))
    out += [struct.pack(">H", r) + _sized(bitset(cs)) for r, cs in rows.items()]
    return base64.urlsafe_b64encode(b"".join(out)).decode().rstrip("=")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def u16(self) -> int:
        return struct.unpack(">H", self.take(2))[0]

    def sized(self) -> bytes:
        return self.take(self.u16())


def decode(text: str, columns: Iterable[int], groups: Iterable[int], rows: Iterable[int]) -> ViewState:
    """Never raises: text of another version, cut short or corrupt gives the empty state; unknown ids are dropped one by one."""
    known_c, known_g, known_r = (x if isinstance(x, range) else set(x) for x in (columns, groups, rows))
    of = lambda ids, known: {i for i in ids if i in known}
    try:
        r = _Reader(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
        version, _, sort, direction, mask = struct.unpack(">BBHBI", r.take(9))
        if version != VERSION:
            return ViewState()
        s = ViewState(sort_column=sort if sort in known_c else None, descending=direction == 1)
        s.collapsed_groups = of((g for g in range(32) if mask >> g & 1), known_g)
        s.hidden_columns = of(ids_of(r.sized()), known_c)
        s.hidden_rows = of(ids_of(r.sized()), known_r)
        for _ in range(r.u16()):
            c, t = r.u16(), r.sized().decode("utf-8", "replace")
            if c in known_c:
                s.filters[c] = t
        for _ in range(r.u16()):
            row, cs = r.u16(), ids_of(r.sized())
            if row in known_r:
                s.selected |= {(row, c) for c in of(cs, known_c)}
        if s.sort_column is None:
            s.descending = False
        return s
    except (ValueError, struct.error):
        return ViewState()


def to_hash(state: ViewState) -> str:
    """'#' and the encoded state; '' where it can't be encoded."""
    try:
        return "#" + encode(state)
    except (ValueError, struct.error, OverflowError):
        return ""


def from_hash(text: str, columns: Iterable[int], groups: Iterable[int], rows: Iterable[int]) -> ViewState:
    body = text.removeprefix("#")
    return decode(body, columns, groups, rows) if body else ViewState()
