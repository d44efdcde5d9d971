"""Ids of repeated pieces of text: each distinct piece is encoded once per worker, texts are assembled by array gathers."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np


class Memo(dict):
    """piece -> place of its ids in one flat array. Emptied by `trim` when it holds more than `limit` pieces or `most` bytes."""

    #: What a piece takes besides its characters and ids: dictionary entry, string and integer objects, place.
    EACH = 200

    def __init__(self, encode: Callable[[str], Sequence[int]], limit: int = 600_000, most: int = 240 << 20):
        super().__init__()
        self.encode, self.limit, self.most = encode, limit, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.flat, self.starts, self.sizes = array("i"), array("i"), array("i")
        self.characters = 0

    @property
    def held(self) -> int:
        """Bytes, with four for each character at most."""
        return self.EACH * len(self) + 4 * (self.characters + len(self.flat))

    def trim(self) -> None:
        if len(self) > self.limit or self.held > self.most:
            self._reset()

    def put(self, piece: str, ids: Sequence[int]) -> int:
        place = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        self.characters += len(piece)
        self[piece] = place
        return place

    def __missing__(self, piece: str) -> int:
        return self.put(piece, self.encode(piece))

    def of(self, piece: str) -> array:
        place = self[piece]
        return self.flat[self.starts[place] : self.starts[place] + self.sizes[place]]

    def ids(self, pieces: Iterable[str], per_text: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many belong to each text (`per_text`: pieces of each)."""
        places = np.fromiter(map(self.__getitem__, pieces), np.int64, sum(per_text))
        sizes = np.frombuffer(self.sizes, np.int32)[places].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(np.frombuffer(self.starts, np.int32)[places] - ends[:-1], sizes)
        source += np.arange(ends[-1])
        return np.frombuffer(self.flat, np.int32)[source], np.diff(ends[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)])
