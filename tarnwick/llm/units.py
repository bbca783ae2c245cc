"""Encoders that remember the units of text (words, runs) they have met."""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache
from itertools import chain

import numpy as np
from pyspark import SparkFiles


def local_file(path: str) -> str:
    """path where it is on this machine, else the file of that name that addFile() brought here."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def bring_file(spark, path: str) -> None:
    """Let every executor have a file of the driver, as `local_file` looks for it."""
    if not any(name.rsplit("/", 1)[-1] == os.path.basename(path) for name in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


_plain: set[str] = set()


@cache
def _marks() -> re.Pattern[str]:
    return re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]{2}")


def is_odd(text: str) -> bool:
    """Whether a text holds what libraries of other Unicode versions may treat otherwise: code points that are unassigned here, or
    several combining marks in a row, which normal forms put in order."""
    if text.isascii():
        return False
    new = set(text).difference(_plain)
    if new:
        odd = {c for c in new if unicodedata.combining(c) or unicodedata.category(c) == "Cn"}
        _plain.update(new - odd)
        return bool(odd) and (any(unicodedata.category(c) == "Cn" for c in odd) or _marks().search(text) is not None)
    return False


class Memo:
    """What units are encoded to, each encoded once by `encode` as long as it is remembered; bounded in units and in characters.

    encode gives, for each channel, the ids of all units in a row and how many each unit has. When it is full, all is
    forgotten; with halve, only the half that was met in the fewest calls, as most units of a long tail come once.
    """

    def __init__(
        self, encode: Callable[[list[str]], Sequence[tuple[np.ndarray, np.ndarray]]], channels: int = 1, most: int = 400_000, most_chars: int = 8 << 20, halve: bool = False
    ) -> None:
        self.encode, self.channels, self.most, self.most_chars, self.halve = encode, channels, most, most_chars, halve
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.calls = np.zeros(0, np.int32)
        self.kept = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(self.channels)]

    def _halve(self) -> None:
        stay = np.sort(np.argsort(-self.calls, kind="stable")[: len(self.calls) // 2])
        told = np.array(list(self.known), object)[stay].tolist()
        self.known = dict(zip(told, range(len(told)), strict=True))
        self.chars = sum(map(len, told))
        self.calls = self.calls[stay] // 2
        for c, (ids, first, count) in enumerate(self.kept):
            first, count = first[stay], count[stay]
            begin = np.cumsum(count) - count
            self.kept[c] = ids[np.repeat(first - begin, count) + np.arange(int(count.sum()))], begin, count

    def of(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each channel the ids of all units in a row, and how many each unit has."""
        new = set(units).difference(self.known)
        chars = sum(map(len, new))
        while self.known and (len(self.known) + len(new) > self.most or self.chars + chars > self.most_chars):
            if self.halve:
                self._halve()
            else:
                self._forget()
            new = set(units).difference(self.known)
            chars = sum(map(len, new))
        if new:
            self.kept = [self._with(*old, *found) for old, found in zip(self.kept, self.encode(list(new)), strict=True)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.chars += chars
            self.calls = np.append(self.calls, np.zeros(len(new), np.int32))
        at, out = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units)), []
        if self.halve:
            self.calls[at] += 1
        for ids, first, count in self.kept:
            count = count[at]
            start = np.repeat(first[at] - np.cumsum(count) + count, count)
            out.append((ids[start + np.arange(len(start))], count))
        return out

    @staticmethod
    def _with(ids: np.ndarray, first: np.ndarray, count: np.ndarray, flat: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([ids, flat]), np.concatenate([first, len(ids) + np.cumsum(more) - more]), np.concatenate([count, more])


def flat(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each list has."""
    lists = list(lists)
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count
