"""File trees as frames (rel, content, list_error), and trees made from tables.

Folders are listed level by level in tasks, and files are read in tasks, FILES_PER_TASK at a time, after paths have been
selected: what is not selected is never opened. The members of a zip archive are read from their offsets. Files whose names
begin with a dot or an underscore, which Spark's own file sources pass over, are seen. Folders that can't be listed and
files that can't be read become rows with list_error. Roots must be paths that all executors see.

The `tree` data source is the same for spark.read.format("tree"), for folders of a size that one task can list; conditions
on rel (=, in, starts with) reach it before files are opened, with its option push and spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import bz2
import json
import lzma
import os
import subprocess
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from driftlens.functions.text import SKIPPED_DIRS, selected
from driftlens.sources.stored import written

FILES_PER_TASK = 200
SCHEMA = "rel string, content binary, list_error string"
# Extensions in the order in which documents take them.
EXTENSIONS = ("c", "h", "arxml", "a2l", "py", "yaml", "json", "txt")


class Files(InputPartition):
    def __init__(self, root: str, files: list[str], failed: list[tuple[str, str]]):
        self.root, self.files, self.failed = root, files, failed


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.wanted: list[Filter] = []

    def _is_wanted(self, rel: str) -> bool:
        told = {EqualTo: lambda f: rel == f.value, In: lambda f: rel in f.value, StringStartsWith: lambda f: rel.startswith(f.value)}
        return all(told[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[Files]:
        files, failed = [], []

        def lost(e: OSError) -> None:
            failed.append((os.path.relpath(e.filename, self.root).replace(os.sep, "/"), str(e)))

        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        for at, dirs, names in os.walk(self.root, onerror=lost):
            dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS)
            files += [os.path.relpath(os.path.join(at, n), self.root).replace(os.sep, "/") for n in sorted(names)]
        files, failed = [x for x in files if self._is_wanted(x)], [x for x in failed if self._is_wanted(x[0])]
        parts = [Files(self.root, files[i : i + FILES_PER_TASK], []) for i in range(0, len(files), FILES_PER_TASK)]
        return parts + ([Files(self.root, [], failed)] if failed or not parts else [])

    def read(self, partition: Files) -> Iterator[tuple]:
        for rel in partition.files:
            try:
                with open(os.path.join(partition.root, rel), "rb") as f:
                    yield rel, f.read(), None
            except OSError as e:
                yield rel, None, str(e)
        for rel, said in partition.failed:
            yield rel, None, said


class PushingReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (Spark's name)
        """Keeps what can be told from a path; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("rel",):
                self.wanted.append(f)
            else:
                yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        kind = PushingReader if self.options.get("push", "").lower() == "true" else TreeReader
        return kind(self.options["path"])


class SourceError(Exception):
    """A zip archive or repository that can't be used."""


def listed(spark: SparkSession, root: str) -> DataFrame:
    """rel, kind (dir, file or error) and said (what went wrong) of all below a folder: a job for each level, a row for each folder to list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, str | None]] = []
            for rel in b.column(0).to_pylist():
                try:
                    with os.scandir(os.path.join(root, rel)) as entries:
                        for e in entries:
                            below = f"{rel}/{e.name}" if rel else e.name
                            if not _is_dir(e):
                                out.append((below, "file", None))
                            elif not e.is_symlink() and e.name not in SKIPPED_DIRS:
                                out.append((below, "dir", None))
                except OSError as e:
                    out.append((rel or ".", "error", str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["rel", "kind", "said"])

    now, levels = spark.createDataFrame([("",)], "rel string"), []
    while n := now.count():
        levels.append(written(now.repartition(min(n, spark.sparkContext.defaultParallelism)).mapInArrow(run, "rel string, kind string, said string"), "listing"))
        now = levels[-1].where("kind = 'dir'").select("rel")
    return reduce(DataFrame.unionByName, levels)


def _is_dir(e: os.DirEntry) -> bool:
    try:
        return e.is_dir()
    except OSError:
        return False


def read_folder(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """A folder's files, of which only selected ones are opened, and what could not be listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel in b.column(0).to_pylist():
                content, said = None, None
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        content = f.read()
                except OSError as e:
                    said = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([rel], pa.string()), pa.array([content], pa.binary()), pa.array([said], pa.string())], names=["rel", "content", "list_error"])

    found = listed(spark, root)
    files = found.where("kind = 'file'").where(selected(F.col("rel"), include, exclude)).select("rel")
    read = files.repartition(max(1, files.count() // FILES_PER_TASK)).mapInArrow(run, SCHEMA)
    return read.unionByName(found.where("kind = 'error'").select("rel", F.lit(None).cast("binary").alias("content"), F.col("said").alias("list_error")))


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """A folder's or zip archive's files."""
    if os.path.isfile(root):
        return read_zip(spark, root, include, exclude)
    if not os.path.isdir(root):
        raise SourceError(f"{root} is neither a folder nor a file")
    return read_folder(spark, root, include, exclude)


def _inside(member: zipfile.ZipInfo) -> bool:
    """Whether a member is a file below the archive's root: no link, no absolute path, no way up."""
    parts = member.filename.replace("\\", "/").split("/")
    link = (member.external_attr >> 16) & 0o170000 == 0o120000
    return not (link or ".." in parts or member.filename.startswith(("/", "\\")) or ":" in parts[0])


def unpacked(f, offset: int, size: int, method: int, crc: int) -> bytes:
    """A member's content, from the header before it on; f is the open archive."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise SourceError(f"no member at offset {offset}")
    f.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), os.SEEK_CUR)
    raw = f.read(size)
    if method == zipfile.ZIP_LZMA:
        lc, lp, pb = raw[4] % 9, raw[4] // 9 % 5, raw[4] // 45
        raw = lzma.decompress(raw[9:], lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": int.from_bytes(raw[5:9], "little"), "lc": lc, "lp": lp, "pb": pb}])
    elif method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15)
    elif method == zipfile.ZIP_BZIP2:
        raw = bz2.decompress(raw)
    elif method != zipfile.ZIP_STORED:
        raise SourceError(f"compression {method} is not known")
    if zlib.crc32(raw) != crc:
        raise SourceError("its checksum is wrong")
    return raw


def read_zip(spark: SparkSession, path: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """A zip archive's files. A lone folder around everything is left out, as are members outside the archive.

    The directory is read once, here; tasks open the archive once each and seek to their members, which are dealt in order
    of offset. A member that can't be read is a row with list_error.
    """
    if not zipfile.is_zipfile(path):
        raise SourceError(f"{path} is no zip archive")
    with zipfile.ZipFile(path) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
    if not members:
        raise SourceError(f"{path} holds no files")
    members = [i for i in members if _inside(i) and not set(i.filename.split("/")[:-1]) & set(SKIPPED_DIRS)]
    if not members:
        raise SourceError(f"{path} holds no files but such as lie outside of it")
    heads = {i.filename.split("/")[0] for i in members}
    cut = len(next(iter(heads))) + 1 if len(heads) == 1 and all("/" in i.filename for i in members) else 0
    rows = [(i.filename[cut:], i.header_offset, i.compress_size, i.compress_type, i.CRC, i.flag_bits & 1) for i in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                for rel, offset, size, method, crc, locked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    content, said = None, None
                    try:
                        if locked:
                            raise SourceError("it is encrypted")
                        content = unpacked(f, offset, size, method, crc)
                    except (OSError, EOFError, SourceError, zlib.error, lzma.LZMAError) as e:
                        said = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_arrays([pa.array([rel], pa.string()), pa.array([content], pa.binary()), pa.array([said], pa.string())], names=["rel", "content", "list_error"])

    table = spark.createDataFrame(rows, "rel string, offset long, size long, method int, crc long, locked int").where(selected(F.col("rel"), include, exclude))
    return table.repartitionByRange(max(1, len(rows) // FILES_PER_TASK), "offset").sortWithinPartitions("offset").mapInArrow(run, SCHEMA)


def repo_root(path: str) -> str:
    """The top folder of the repository that a folder or file lies in."""
    return _git(path if os.path.isdir(path) else os.path.dirname(path) or ".", "rev-parse", "--show-toplevel").decode().strip()


def rel_in_repo(path: str) -> str:
    """A path from its repository's top folder, '' for that folder."""
    rel = os.path.relpath(os.path.realpath(path), os.path.realpath(repo_root(path))).replace(os.sep, "/")
    return "" if rel == "." else rel


def resolve(repo: str, revision: str) -> str:
    """The full name of the commit that a revision stands for. What begins like an option is none."""
    if revision.startswith("-"):
        raise SourceError(f"{revision} is no revision")
    return _git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


def label(source: str) -> str:
    """What a folder or archive is called in reports."""
    return os.path.basename(os.path.abspath(source)) or source


def git_log(repo: str, sub: str = ".", limit: int | None = None) -> list[tuple[str, str, str, str, str]]:
    """(sha, short, date, author, subject) of the commits that touch sub, the latest first; with a limit, so many."""
    few = [] if limit is None else [f"-n{limit}"]
    out = _git(repo, "log", *few, "--date=short", "--format=%H%x1f%h%x1f%ad%x1f%an%x1f%s", "--", sub)
    return [tuple(x.split("\x1f")) for x in out.decode("utf-8", "replace").splitlines() if x]


def read_commit(spark: SparkSession, repo: str, revision: str, into: str, sub: str = "") -> DataFrame:
    """The tree of a commit. The archive is written to into, a folder that all executors see."""
    sha = resolve(repo, revision)
    path = os.path.join(into, f"{sha}.zip")
    if not os.path.exists(path):
        _git(repo, "archive", "--format=zip", f"--output={path}", f"{sha}:{sub}" if sub else sha)
    return read_zip(spark, path)


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=False)
    if done.returncode:
        raise SourceError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def read_review(path: str) -> tuple[dict, str | None]:
    """Entries {rel: {unit: {note, reviewed, at, where}}} and what is wrong with the file, if anything. A missing file is empty."""
    if not os.path.exists(path):
        return {}, None
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        if found.get("schema") != 1 or not isinstance(found["entries"], dict):
            raise ValueError("not a review file of schema 1")
        return found["entries"], None
    except (OSError, ValueError, KeyError, AttributeError) as e:
        return {}, str(e)


def review_path(new_root: str) -> str:
    """Where the review of a current folder is kept unless told otherwise: beside it, as it may be made anew."""
    return os.path.join(os.path.dirname(os.path.abspath(new_root)), "codegen-review.json")


def review_entries(spark: SparkSession, path: str) -> DataFrame:
    """A review file's entries as rows (rel, unit_key, note, reviewed)."""
    entries, wrong = read_review(path)
    if wrong:
        raise SourceError(f"{path}: {wrong}")
    rows = [(rel, key, e.get("note"), bool(e.get("reviewed"))) for rel, units in entries.items() for key, e in units.items()]
    return spark.createDataFrame(rows, "rel string, unit_key string, note string, reviewed boolean")


def save_review(path: str, entries: dict) -> None:
    """Writes the entries, but never over a file that can't be read."""
    wrong = read_review(path)[1]
    if wrong:
        raise SourceError(f"{path} is not overwritten: {wrong}")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema": 1, "tool": "driftlens", "entries": entries}, f, ensure_ascii=False, indent=1, sort_keys=True)


def _ext(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc_id % 8 + 1).cast("int"))


def document_trees(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two trees (rel, text) from documents: some files added, deleted, moved or edited, by doc_id."""
    i = F.col("doc_id")
    rel = F.concat("source", F.lit("/d"), i.cast("string"), F.lit("."), _ext(i))
    old = docs.where(i % 50 != 1).select(rel.alias("rel"), "text")
    edit = (
        F.when(i % 50 == 2, F.concat("text", F.lit("\n// tail")))
        .when(i % 7 == 1, F.concat("text", F.lit("\n/* regenerated */")))
        .when(i % 7 == 2, F.replace("text", F.lit(" "), F.lit("  ")))
        .when(i % 7 == 3, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(i % 7 == 4, F.concat(F.lit("X"), "text"))
        .when(i % 7 == 5, F.concat(F.lit("// banner\n"), "text"))
        .otherwise(F.col("text"))
    )
    moved = F.concat(F.lit("moved/d"), i.cast("string"), F.lit("."), _ext(i))
    new = docs.where(i % 50 != 0).select(F.when(i % 50 == 2, moved).otherwise(rel).alias("rel"), edit.alias("text"))
    return old, new


def code_trees(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two trees of C and A2L files (rel, text): documents with access points and calibration objects in them."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    m = F.concat(F.lit("m"), s((i / 2).cast("long") % 200))

    def side(k: int) -> DataFrame:
        p = (i + k * (i % 3)) % 13
        c = F.concat(F.lit("// Rte_Call_old_x\nv = Rte_Read_P"), s(p), F.lit("_Sig();\nRte_Write_Q"), s(i % 5), F.lit('_Out(v); /* Rte_Mode_no */\nlog("Rte_Pim_text"); rtb_Sum_c'), s((i + k) % 9), F.lit(" = tmp_"), s(i % 4), F.lit(";\n"), "text")
        a = F.concat(F.lit("/begin CHARACTERISTIC K_"), s(p), F.lit(' "/begin MEASUREMENT no" /* /begin MEASUREMENT no2 */\n/begin measurement M_'), s(i % 7), F.lit("\n"), "text")
        is_c = i % 2 == 0
        files = docs.select(F.concat(m, F.lit("/"), m, F.lit("_f"), s(i), F.when(is_c, ".c").otherwise(".a2l")).alias("rel"), F.when(is_c, c).otherwise(a).alias("text"), "doc_id")
        return files.where(i % 25 != k).drop("doc_id")

    return side(0), side(1)
