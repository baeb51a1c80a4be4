"""Datagrams as a stream: one row per packet that has arrived at a port.

A datagram is gone once it is read, so the reader keeps what it has handed out until the query commits it, and
hands it out again if a batch is repeated.  A driver that dies loses what it holds, as the sender does not repeat
packets; mirroring needs the newest only.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

PACKET_BYTES = 65_535
MAX_PACKETS = 10_000  # of one batch; more wait in the socket, which drops what it cannot hold


class Datagrams(DataSource):
    """``value`` (text) and ``received`` (seconds).  Options: ``host`` (default 127.0.0.1), ``port``."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType()), StructField("received", DoubleType())])

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return DatagramReader(self.options.get("host", "127.0.0.1"), int(self.options["port"]))


class DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, host: str, port: int) -> None:
        self.address = host, port
        self.socket = None
        self.held: list[tuple[str, float]] = []
        self.first = 0  # number of the first packet held

    def initialOffset(self) -> dict:
        return {"packet": 0}

    def _arrived(self) -> None:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        for _ in range(MAX_PACKETS):
            try:
                content = self.socket.recv(PACKET_BYTES)
            except BlockingIOError:
                break
            self.held.append((content.decode(errors="replace"), time.time()))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._arrived()
        after = self.first + len(self.held)
        # After a restart numbers go on from the committed offset.
        if start["packet"] > after:
            self.first, after = start["packet"], start["packet"] + len(self.held)
        return iter(self.held[max(0, start["packet"] - self.first) :]), {"packet": after}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.held[max(0, start["packet"] - self.first) : max(0, end["packet"] - self.first)])

    def commit(self, end: dict) -> None:
        done = max(0, end["packet"] - self.first)
        self.held, self.first = self.held[done:], max(self.first, end["packet"])
