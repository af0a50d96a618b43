"""Commits of a Git repository as a Spark data source: format("quarry_git")."""

from __future__ import annotations

import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class GitSource(DataSource):
    """Options: path, depth (10240), merges (false). Rows: commit_id, author, message, path."""

    @classmethod
    def name(cls) -> str:
        return "quarry_git"

    def schema(self) -> str:
        return "commit_id string, author string, message string, path string"

    def reader(self, schema):
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.depth, self.merges = options.get("path", "."), int(options.get("depth", 10240)), options.get("merges", "false") == "true"

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        # without a repository there is no history
        cmd = ["git", "-C", self.path, "log", f"--max-count={self.depth}", "--name-only", "-z", "--format=%x01%H%x02%an%x02%s%x02", *([] if self.merges else ["--no-merges"])]
        done = subprocess.run(cmd, capture_output=True)
        if done.returncode:
            return
        for commit in done.stdout.decode("utf-8", "replace").split("\x01")[1:]:
            head, author, message, files = commit.split("\x02", 3)
            for f in files.replace("\n", "\0").split("\0"):
                if f:
                    yield head, author, message, f
