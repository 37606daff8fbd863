"""Bytes put together from pieces by offset: in any order, repeated and overlapping, as packets bring them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class Intervals:
    """Pieces that neither touch nor overlap, in order. Of bytes that come twice the first count."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.parts: list[bytearray] = []

    def put(self, offset: int, piece: bytes) -> None:
        at = max(bisect_right(self.starts, offset) - 1, 0)
        end = offset + len(piece)
        new, fresh = bytearray(piece), []
        # what is held of the new piece's range goes over it, and joins it to its neighbours
        while at < len(self.starts) and self.starts[at] <= end:
            start, held = self.starts[at], self.parts[at]
            if start + len(held) < offset:
                at += 1
                continue
            fresh.append((start, held))
            at += 1
        if not piece:
            return
        low, high = min([offset, *(s for s, _ in fresh)]), max([end, *(s + len(h) for s, h in fresh)])
        whole = bytearray(high - low)
        whole[offset - low : end - low] = new
        for start, held in fresh:
            whole[start - low : start - low + len(held)] = held
        first = bisect_left(self.starts, fresh[0][0]) if fresh else bisect_left(self.starts, offset)
        self.starts[first : first + len(fresh)] = [low]
        self.parts[first : first + len(fresh)] = [whole]

    def after(self, offset: int) -> bytes:
        """The bytes from an offset on, as far as there is no gap."""
        at = bisect_right(self.starts, offset) - 1
        return bytes(self.parts[at][offset - self.starts[at] :]) if at >= 0 else b""

    def size(self) -> int:
        return sum(map(len, self.parts))


class Greetings:
    """The greetings of one side of TLS connections from its segments by sequence number: a record once it is whole.

    Segments may come in any order, repeat and overlap, and numbers may pass 2 ** 32. A greeting begins where a segment
    does. What is not whole `wait` microseconds after its first segment, or grows beyond `most` bytes, is given up.
    """

    def __init__(self, wait: int = 10_000_000, most: int = 1 << 17):
        self.wait, self.most, self.idle = wait, most, wait + 1
        self._clear()

    def _clear(self) -> None:
        self.since, self.first, self.held, self.begins = None, 0, Intervals(), []

    def run(self, at, numbers, payloads) -> list:
        return [self._on(*x) for x in zip(at, numbers, payloads, strict=True)]

    def _on(self, at: int, number: int, payload: bytes) -> bytes | None:
        if self.since is not None and (at - self.since > self.wait or self.held.size() + len(payload) > self.most):
            self._clear()
        if self.since is None:
            self.since, self.first = at, number
        offset = (number - self.first + (1 << 31)) % (1 << 32) - (1 << 31)
        if abs(offset) > self.most:
            return None
        self.held.put(offset, payload)
        if payload[:2] == b"\x16\x03":
            self.begins.append(offset)
        for begin in self.begins:
            data = self.held.after(begin)
            size = 5 + int.from_bytes(data[3:5])
            if len(data) > 5 and data[5] == 1 and len(data) >= size:
                self._clear()
                return data[:size]
        return None
