"""Write sink ``session_files``: rows (folder, session, chunk, value) become one text
file per session and chunk, ``<path>/cwd_key=<folder>/session-<session>.jsonl``.

Rows arrive sorted by folder, session, chunk and line, so a task has one open
file and holds one batch. A file is written under a hidden name and renamed when
it is complete. Its final name follows from its content's key alone: a task that
runs again, after an executor was lost, replaces its own files. The job's commit
writes ``_SUCCESS``; a failed job leaves no such mark.

Later chunks of a session are ``session-<session>~<chunk>.jsonl``, eight digits, so
that name order is line order. Characters of ids that a name cannot hold are
percent-encoded; a null or empty folder is Spark's default partition name. Option
``suffix`` names another ending than ``.jsonl``.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "session_files"
SCHEMA = "cwd_key string, session_id string, chunk bigint, value string"
#: Pattern of a later chunk's file name; what it matches is replaced by ``.jsonl`` for the session's file.
LATER_CHUNK = r"~[0-9]{8}\.jsonl$"


def folder_name(cwd_key: str | None) -> str:
    return "cwd_key=" + (quote(cwd_key, safe=" ") if cwd_key else "__HIVE_DEFAULT_PARTITION__")


def file_name(session_id: str, chunk: int, suffix: str = ".jsonl") -> str:
    part = f"~{chunk:08d}" if chunk else ""
    return f"session-{quote(session_id, safe='').replace('~', '%7E')}{part}{suffix}"


def file_system(path: str):
    """(file system, path in it) of a URI or a plain absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class SessionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> SessionFilesWriter:
        return SessionFilesWriter(self.options["path"].rstrip("/"), overwrite, self.options.get("suffix", ".jsonl"))


class SessionFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, suffix: str = ".jsonl"):
        self.path, self.suffix = path, suffix
        if overwrite:  # as Spark's own file sinks: what was there goes before the job
            fs, root = file_system(path)
            fs.delete_dir_contents(root, missing_dir_ok=True)

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        key = target = hidden = out = None
        try:
            for batch in iterator:
                for *k, value in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != key:
                        if out is not None:
                            out.close()
                            _rename(fs, hidden, target)
                        key, out = k, None
                        folder = f"{root}/{folder_name(k[0])}"
                        fs.create_dir(folder, recursive=True)
                        target, hidden = f"{folder}/{file_name(k[1], k[2], self.suffix)}", f"{folder}/_{uuid.uuid4().hex}"
                        out = fs.open_output_stream(hidden)
                    out.write((value + "\n").encode())
            if out is not None:
                out.close()
                _rename(fs, hidden, target)
                out = None
        finally:
            if out is not None:
                out.close()
                fs.delete_file(hidden)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        fs.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages) -> None:
        """Files of a failed job stay without ``_SUCCESS``; writing again replaces them."""


def _rename(fs, source: str, target: str) -> None:
    try:
        fs.move(source, target)
    except OSError:  # file systems that do not replace: an earlier attempt's file goes first
        fs.delete_file(target)
        fs.move(source, target)
