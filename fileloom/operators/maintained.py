"""Groups of duplicates that are kept until something changes: a table by content, made with one rule
of one version of the files, and brought up to date from the files that have changed since."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from . import keepers
from .keepers import KeeperRule
from .logstore import Store
from .storage import stored


class MaintainedGroups:
    """files: a store by path, with md5 and what the rule looks at. The groups lie in a store of their
    own, whose newest version names the rule and the files' version that it holds for."""

    def __init__(self, files: Store, folder: str):
        self.files, self.view = files, Store(files.spark, folder)

    @staticmethod
    def fingerprint(rule: KeeperRule) -> str:
        return hashlib.sha256(repr(rule).encode()).hexdigest()

    def groups(self, rule: KeeperRule) -> DataFrame:
        """The groups of the files as they are now: md5, keeper, redundant_count, reclaim, cross_folder,
        ambiguous, ai_resolved. Nothing is computed if neither files nor rule have changed; contents
        of changed, purged and returned paths are computed anew; and everything is after a change of
        the rule, or where the files' store doesn't know what has changed."""
        self.refresh(rule)
        return self.view.read()

    def refresh(self, rule: KeeperRule) -> str:
        """Brings the view up to date and returns what that took: nothing, changed or whole."""
        now, note = self.files.version(), self.view.note()
        mark = {"rule": self.fingerprint(rule), "files": now}
        if note == mark:
            return "nothing"
        paths = self.files.changed_since(note["files"], now) if note.get("rule") == mark["rule"] else None
        if paths is None:
            self.view.write(keepers.groups(keepers.marked(self.files.read(now), rule)), note=mark)
            return "whole"
        key = self.files._manifest(now)["key"]
        before, after = self.files.read(note["files"]), self.files.read(now)
        touched = before.join(paths, key, "left_semi").select("md5").unionByName(after.join(paths, key, "left_semi").select("md5"))
        touched = stored(touched.filter("md5 is not null").distinct(), "touched")
        copies = after.join(touched, "md5", "left_semi")
        self.view.replace(keepers.groups(keepers.marked(copies, rule)), "md5", named=touched, note=mark)
        return "changed"
