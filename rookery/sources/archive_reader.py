"""Monthly archives read game by game, in batches or as a stream: no month has to fit into a row or into memory.

The reader only cuts a month's text into the texts of its games; Spark parses those. A month that can't be decoded to its end gives
none of its games, only a row with `error`. To know that, a task reads a month once before it tells anything, and keeps its games
meanwhile: up to KEEP bytes in memory, a longer month in a temporary file. At most one game (MOST characters) and KEEP are held.
Compressed months (.gz and others that their names tell) are read as they are.
"""

from __future__ import annotations

import io
import json
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of games that a task keeps in memory while it reads a month; bytes of months in one task; characters of a single game.
KEEP, TASK, MOST = 32 << 20, 32 << 20, 64 << 20
CHUNK = 1 << 20
SCHEMA = "player string, year int, month int, file string, arrival int, game string, error string"
_CONTROL = re.compile(r"[\x00-\x1f]")
_GAP = re.compile(r"[ \t\r\n]*")


class Broken(ValueError):
    """A month's text isn't an archive."""


class _Text:
    """A window on a text that is read in pieces: one JSON value or mark at a time."""

    def __init__(self, source: io.TextIOBase, repair: bool, most: int):
        self.source, self.repair, self.most, self.text, self.at, self.done = source, repair, most, "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def more(self) -> bool:
        """Another piece, at least as long as what is held, so that a long value is tried few times."""
        held = len(self.text) - self.at
        if held > self.most:
            raise Broken("a value is too long")
        piece = "" if self.done else self.source.read(max(CHUNK, held))
        self.done = not piece
        self.text, self.at = self.text[self.at :] + (_CONTROL.sub(" ", piece) if self.repair else piece), 0
        return bool(piece)

    def mark(self) -> str:
        """The next character that isn't a gap; '' at the end. It isn't taken."""
        while True:
            self.at = _GAP.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, marks: str) -> str:
        found = self.mark()
        if not found or found not in marks:
            raise Broken(f"one of {marks} expected, {found or 'the end'} found")
        self.at += 1
        return found

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.mark()
        while True:
            try:
                told, end = self.decode(self.text, self.at)
                if end < len(self.text) or self.done or not self.more():  # a number may go on in the next piece
                    text, self.at = self.text[self.at : end], end
                    return told, text
            except json.JSONDecodeError as e:
                if not self.more():
                    raise Broken(str(e)) from e
            except RecursionError as e:
                raise Broken("values are nested too deeply") from e


def games_of(source: io.TextIOBase, repair: bool = False, most: int = MOST) -> Iterator[str]:
    """The texts of an archive's games, one at a time. A missing or null list has none; nulls in the list aren't games."""
    text = _Text(source, repair, most)
    text.take("{")
    if text.mark() == "}":
        text.take("}")
    else:
        while True:
            name, _ = text.value()
            if not isinstance(name, str):
                raise Broken("a name expected")
            text.take(":")
            if name != "games" or text.mark() != "[":
                told, _ = text.value()
                if name == "games" and told is not None:
                    raise Broken("games aren't a list")
            else:
                text.take("[")
                if text.mark() == "]":
                    text.take("]")
                else:
                    while True:
                        told, body = text.value()
                        if told is not None:
                            if not isinstance(told, dict):
                                raise Broken("a game isn't an object")
                            yield body
                        if text.take(",]") == "]":
                            break
            if text.take(",}") == "}":
                break
    if text.mark():
        raise Broken("text after the end")


class Months(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(time of the last change, name below the folder, bytes) of all months."""
    from pyarrow import fs

    system, root = _system(path)
    root = root.rstrip("/")
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda name: any(p.startswith((".", "_")) for p in name.split("/"))
    rows = [(f.mtime_ns or 0, f.path.removeprefix(root + "/"), f.size or 0) for f in found if f.type == fs.FileType.File]
    return sorted(r for r in rows if not hidden(r[1]))


def _packed(path: str, rows: list[tuple[int, str, int]], tasks: int) -> list[Months]:
    """Tasks of about TASK bytes, less where that leaves some of `tasks` idle; a larger month is a task of its own."""
    packs, held = [], 0
    most = min(TASK, max(CHUNK, sum(size for _, _, size in rows) // tasks))
    for _, name, size in rows:
        if not packs or held + size > most:
            packs.append([])
            held = 0
        packs[-1].append((path, name))
        held += size
    return [Months(p) for p in packs]


def _grouped(games: Iterator[str]) -> Iterator[list[str]]:
    """Games by about CHUNK characters."""
    held, size = [], 0
    for game in games:
        held.append(game)
        size += len(game)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _rows(head: dict, games, first: int | None, error: str | None):
    """An Arrow batch of SCHEMA: a month's games from number `first` on, or its error."""
    import pyarrow as pa

    n, types = len(games), {"player": pa.string(), "year": pa.int32(), "month": pa.int32(), "file": pa.string()}
    same = lambda value, kind: pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)
    arrival = pa.nulls(n, pa.int32()) if first is None else pa.array(range(first, first + n), pa.int32())
    columns = {k: same(head[k], kind) for k, kind in types.items()} | {"arrival": arrival, "game": games, "error": same(error, pa.string())}
    return pa.record_batch(columns)


class _Reads:
    """What both readers do with a task's months."""

    def __init__(self, options: dict):
        self.path, self.repair = options["path"].rstrip("/"), str(options.get("repair", "false")).lower() == "true"
        self.keep, self.most = int(options.get("keep", KEEP)), int(options.get("most", MOST))
        self.tasks = int(options.get("tasks", 1))

    def read(self, partition: Months | None) -> Iterator:
        """Arrow batches of SCHEMA."""
        import pyarrow as pa

        for path, name in partition.files if partition else []:  # where there are no months, Spark asks without a partition
            where = dict(p.split("=", 1) for p in name.split("/")[:-1] if "=" in p)
            number = lambda k: int(where[k]) if where.get(k, "").isdigit() else None
            head = {"player": where.get("player"), "year": number("year"), "month": number("month"), "file": f"{path}/{name}"}
            with tempfile.SpooledTemporaryFile(self.keep) as kept:
                try:
                    with pa.ipc.new_stream(kept, pa.schema([("game", pa.string())])) as out:
                        for games in _grouped(self._games(path, name)):
                            out.write_batch(pa.record_batch([pa.array(games, pa.string())], names=["game"]))
                except Broken as e:
                    yield _rows(head, pa.nulls(1, pa.string()), None, str(e))
                    continue
                kept.seek(0)
                at = 0
                for games in pa.ipc.open_stream(kept):
                    yield _rows(head, games.column(0), at, None)
                    at += games.num_rows

    def _games(self, path: str, name: str) -> Iterator[str]:
        system, root = _system(path)
        with system.open_input_stream(f"{root}/{name}") as raw:
            yield from games_of(io.TextIOWrapper(raw, "utf-8", errors="replace", newline=""), self.repair, self.most)


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[Months]:
        return _packed(self.path, _listed(self.path), self.tasks)


class _Stream(_Reads, DataSourceStreamReader):
    """An offset is the last change and name of the last month that was told. Months that changed less than `settle` seconds ago wait
    for the next batch, so that none is overtaken by one that is written at the same time, or read half written."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settle", 60))

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        import time

        ready = [r for r in _listed(self.path) if r[0] <= time.time_ns() - int(self.settle * 1e9)]
        return {"time": ready[-1][0], "name": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Months]:
        low, high = ((o["time"], o["name"]) for o in (start, end))
        return _packed(self.path, [r for r in _listed(self.path) if low < r[:2] <= high], self.tasks)

    def commit(self, end: dict) -> None:
        pass


class GameArchives(DataSource):
    """Format `game_archives`: a row for each game's text, and one with `error` for each broken month."""

    @classmethod
    def name(cls) -> str:
        return "game_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def _options(spark: SparkSession, path: str, repair: bool, more: dict) -> dict[str, str]:
    return {"path": path, "repair": str(repair), "tasks": str(spark.sparkContext.defaultParallelism)} | {k: str(v) for k, v in more.items()}


def archive_rows(spark: SparkSession, path: str, repair: bool = False, **options) -> DataFrame:
    """Rows of SCHEMA for all months under player=.../year=.../month=... ."""
    spark.dataSource.register(GameArchives)
    return spark.read.format("game_archives").options(**_options(spark, path, repair, options)).load()


def stream_archives(spark: SparkSession, path: str, repair: bool = False, **options) -> DataFrame:
    """The same as a stream: months that are new or have changed since the last batch."""
    spark.dataSource.register(GameArchives)
    return spark.readStream.format("game_archives").options(**_options(spark, path, repair, options)).load()


def opened(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games, broken) of archive rows, as read_archives gives them; broken months carry their error instead of their text."""
    from .archives import GAME

    told = F.inline(F.array(F.from_json("game", GAME, {"allowUnquotedControlChars": "true"})))  # parsed once, whatever is asked of it
    return rows.where("error IS NULL").select("player", "year", "month", "file", "arrival", told), rows.where("error IS NOT NULL").select("player", "year", "month", "file", "error")
