"""The tee: each insert is also sent to a TCP address, as a JSON line for each point."""

from __future__ import annotations

import json
import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from tidewell.errors import QueryError
from tidewell.sources.points import VALUE


def parsed(address: str) -> tuple[str, int]:
    """host and port of HOST:PORT, [HOST]:PORT or HOST."""
    host, colon, port = address.rpartition(":") if "]" not in address or address.rpartition("]")[2] else (address, "", "")
    if not colon:
        host, port = address, "9104"
    if not port.isdigit() or not 0 < int(port) < 65536 or not host.strip("[]"):
        raise QueryError("Invalid tee address; expecting ADDRESS[:PORT]")
    return host.strip("[]"), int(port)


def tcp_tee(points: DataFrame, address: str, timeout: float = 10.0) -> None:
    """Sends the points, a connection for each partition; a retried task sends its part again."""
    host, port = parsed(address)

    def send(rows: Iterator[Row]) -> None:
        connection = None
        try:
            for row in rows:
                if connection is None:
                    connection = socket.create_connection((host, port), timeout)
                line = json.dumps({"name": row["series"], "points": [[row["ts"], row[VALUE[row["tp"]]]]]})
                connection.sendall(line.encode() + b"\n")
        finally:
            if connection is not None:
                connection.close()

    points.foreachPartition(send)
