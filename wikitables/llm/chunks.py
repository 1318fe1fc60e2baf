"""Byte-level BPE per chunk between spaces, with a bounded memory of chunks.

A space between two characters that are not white space always starts a new
match of the byte-level pattern, so such chunks can be encoded apart and their
ids joined.  Texts in which a chunk is empty, or begins or ends with other
white space, are encoded whole.
"""

from __future__ import annotations

# Chunks remembered by one Python worker.
REMEMBERED = 500_000


class ChunkMemory:
    """Ids of texts as little-endian unsigned 32-bit integers; subclasses encode what is not remembered."""

    def __init__(self) -> None:
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        raise NotImplementedError

    def spaced(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk with a space before it."""
        raise NotImplementedError

    def _learn(self, chunks: set[str]) -> None:
        """Remember new chunks; None marks those that can't stand apart."""
        for odd in [c for c in chunks if not c or c[0].isspace() or c[-1].isspace()]:
            chunks.discard(odd)
            self.known[odd] = None
        listed = list(chunks)
        if listed:
            self.known.update(zip(listed, self.spaced(listed), strict=True))

    def _ids(self, chunks: list[str]) -> bytes | None:
        new = set(chunks).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(chunks)
            self._learn(new)
        found = list(map(self.known.__getitem__, chunks))
        return None if None in found else b"".join(found)

    def text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.whole(text)
        out = [self.whole(first)]
        for at in range(0, len(rest), REMEMBERED // 4):
            part = rest[at : at + REMEMBERED // 4]
            found = list(map(self.known.get, part))
            ids = b"".join(found) if None not in found else self._ids(part)
            if ids is None:
                return self.whole(text)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        # One look at the new chunks of all texts: fewer, longer calls.
        new = {c for t in texts for c in t.split(" ")[1:]}.difference(self.known)
        if new and len(self.known) + len(new) <= REMEMBERED:
            self._learn(new)
        return [self.text(t) for t in texts]
