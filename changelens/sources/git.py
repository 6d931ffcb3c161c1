"""Git as a Python data source: commits, commit files, tracked files, diffs, contents and refs
of a clone.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("path", repo).option("kind", "commits").load()

Each kind reads with one git process a task. A range of commits is one partition, so a long
history is read by several tasks. Paths come as they are (git's -z), never quoted; a merge is
compared with its first parent.

kinds and their options:
    commits, commit_files   ref (HEAD), limit (500), rows_per_task (500); newest first
    files                   ref: what it tracks; without it, what the index tracks
    diff_files, diff_text   base, head
    content                 ref, file
    refs                    branches, remote branches and tags
    resolve                 ref: a commit, else origin/ref, a branch, a tag, else HEAD
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "sha string, parent string, author string, email string, author_seconds long, commit_seconds long, message string, insertions long, deletions long",
    "commit_files": "sha string, path string, insertions long, deletions long, lines long",
    "files": "path string, mode string, blob string, bytes long",
    "diff_files": "path string, change_type string, old_path string",
    "diff_text": "base string, head string, text string",
    "content": "path string, content binary",
    "refs": "name string, kind string, sha string",
    "resolve": "ref string, sha string",
}
# git's letters for what happened to a file; any other is a modification.
CHANGES = {"A": "added", "D": "deleted", "R": "renamed"}
_MARK, _FIELD = "\x1e", "\x1f"


def _raw(path: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True).stdout


def _git(path: str, *args: str) -> str:
    return _raw(path, *args).decode("utf-8", "replace")


class Slice(InputPartition):
    def __init__(self, skip: int, count: int) -> None:
        self.skip, self.count = skip, count


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.kind = options.get("kind", "commits")
        self.given = options.get("ref", None)
        self.ref = self.given or "HEAD"
        self.base, self.head, self.file = options.get("base", None), options.get("head", "HEAD"), options.get("file", None)
        self.limit = int(options.get("limit", "500"))
        self.rows = int(options.get("rows_per_task", "500"))

    def partitions(self) -> list[Slice]:
        if self.kind not in ("commits", "commit_files"):
            return [Slice(0, 0)]
        return [Slice(at, min(self.rows, self.limit - at)) for at in range(0, self.limit, self.rows)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return getattr(self, f"_{self.kind}")(partition)

    def _log(self, partition: Slice, form: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
        """The header of each commit of a range, and path, insertions and deletions of its
        files; a binary file has none."""
        window = (f"--skip={partition.skip}", f"--max-count={partition.count}")
        head, files = None, []
        # A message or a path holds no NUL; _MARK begins a header, which no count of lines does.
        for cell in _git(self.path, "log", *window, "-z", "--diff-merges=first-parent", "--numstat", "--no-renames", f"--format={_MARK}{form}%x00", self.ref).split("\0"):
            if cell.lstrip("\n").startswith(_MARK):
                if head is not None:
                    yield head, files
                head, files = cell.lstrip("\n")[1:], []
            elif cell.strip("\n"):
                added, removed, path = cell.lstrip("\n").split("\t", 2)
                files.append((path, *(int(x) if x.isdigit() else 0 for x in (added, removed))))
        if head is not None:
            yield head, files

    def _commits(self, partition: Slice) -> Iterator[tuple]:
        form = _FIELD.join(("%H", "%P", "%an", "%ae", "%at", "%ct", "%B"))
        for head, files in self._log(partition, form):
            sha, parents, author, email, at, committed, message = head.split(_FIELD, 6)
            yield sha, parents.split(" ")[0] or None, author, email, int(at), int(committed), message.strip(), sum(f[1] for f in files), sum(f[2] for f in files)

    def _commit_files(self, partition: Slice) -> Iterator[tuple]:
        for sha, files in self._log(partition, "%H"):
            for path, added, removed in files:
                yield sha, path, added, removed, added + removed

    def _files(self, _: Slice) -> Iterator[tuple]:
        if self.given is None:
            for path in _git(self.path, "ls-files", "-z").split("\0"):
                if path:
                    yield path, None, None, None
            return
        for line in _git(self.path, "ls-tree", "-r", "-l", "-z", self.ref).split("\0"):
            if line:
                meta, path = line.split("\t", 1)
                mode, _kind, blob, size = meta.split()
                yield path, mode, blob, int(size) if size.isdigit() else None

    def _diff_files(self, _: Slice) -> Iterator[tuple]:
        cells = iter(_git(self.path, "diff", "-z", "--name-status", "-M", self.base, self.head).split("\0"))
        for letter in cells:
            if letter:
                change, old = CHANGES.get(letter[0], "modified"), next(cells)
                path = next(cells) if letter[0] in "RC" else old
                yield path, change, old if change == "renamed" else None

    def _diff_text(self, _: Slice) -> Iterator[tuple]:
        yield self.base, self.head, _git(self.path, "diff", self.base, self.head)

    def _content(self, _: Slice) -> Iterator[tuple]:
        yield self.file, _raw(self.path, "show", f"{self.ref}:{self.file}")

    def _refs(self, _: Slice) -> Iterator[tuple]:
        kinds = {"heads": "branch", "remotes": "remote", "tags": "tag"}
        for line in _git(self.path, "for-each-ref", "--format=%(refname)%00%(objectname)%00%(*objectname)").splitlines():
            name, sha, peeled = line.split("\0")
            kind = name.split("/")[1]
            if kind in kinds:
                yield name.split("/", 2)[2], kinds[kind], peeled or sha

    def _resolve(self, _: Slice) -> Iterator[tuple]:
        for name in (self.ref, f"origin/{self.ref}", f"refs/heads/{self.ref}", f"refs/tags/{self.ref}", "HEAD"):
            try:
                sha = _git(self.path, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{name}^{{commit}}").strip()
            except subprocess.CalledProcessError:
                continue
            yield self.ref, sha
            return
