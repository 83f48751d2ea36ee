"""Live swap: of the folders that share a prefix, the one with the greatest name is current."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame, SparkSession

from ..operators.topk import Query
from .files import Folder
from .store import Store

POLL_SECONDS = 10.0
_LOG = logging.getLogger(__name__)


class VersionedStore:
    """View of the newest version below ``parent`` whose name starts with ``prefix``; it never goes back."""

    def __init__(self, spark: SparkSession, parent: str, prefix: str):
        self.spark, self.parent, self.prefix = spark, parent.rstrip("/"), prefix
        self.name: str | None = None
        self.store: Store | None = None
        self._ended = threading.Event()
        self.refresh()

    def refresh(self) -> bool:
        """Switch to a newer version, if there is one; a folder counts from its first committed batch on."""
        names = [n for n in Folder(self.spark, self.parent).folders() if n.startswith(self.prefix)]
        for name in reversed(names):
            if self.name is not None and name <= self.name:
                return False
            store = Store(self.spark, f"{self.parent}/{name}")
            if store.manifest["version"]:
                self.store, self.name = store, name
                return True
        return False

    def watch(self, seconds: float = POLL_SECONDS) -> threading.Thread:
        """Refresh every so many seconds in the background until :meth:`close`; a version that cannot be read is tried again."""

        def poll() -> None:
            while not self._ended.wait(seconds):
                try:
                    if self.refresh():
                        _LOG.info("now serving %s/%s", self.parent, self.name)
                except Exception as e:  # the folder is not there, or half copied
                    _LOG.warning("cannot read versions below %s: %s", self.parent, e)

        thread = threading.Thread(target=poll, name="versions", daemon=True)
        thread.start()
        return thread

    def close(self) -> None:
        self._ended.set()

    def _current(self) -> Store:
        if self.store is None:
            raise LookupError(f"no version {self.prefix}* below {self.parent} yet")
        return self.store

    def query(self, query: Query) -> DataFrame:
        return self._current().query(query)

    def bulk_index(self, records: DataFrame) -> int:
        return self._current().bulk_index(records)
