"""A socket server around a warm session: frames of a 4-byte big-endian length and JSON.

Requests: {"query": ..., "top_k": ...}, {"command": "status"} and {"command": "shutdown"}.
"""

from __future__ import annotations

import json
import socket
import socketserver
import struct
import time
from collections.abc import Callable

LARGEST_FRAME = 10 * 1024 * 1024


def send_frame(sock: socket.socket, message: dict) -> None:
    data = json.dumps(message, default=str).encode()
    sock.sendall(struct.pack(">I", len(data)) + data)


def _exactly(sock: socket.socket, n: int) -> bytes:
    data = b""
    while len(data) < n:
        part = sock.recv(min(65536, n - len(data)))
        if not part:
            raise ConnectionError("closed within a frame")
        data += part
    return data


def receive_frame(sock: socket.socket) -> dict:
    size = struct.unpack(">I", _exactly(sock, 4))[0]
    if size > LARGEST_FRAME:
        raise ValueError(f"a frame of {size} bytes")
    return json.loads(_exactly(sock, size))


class SearchServer(socketserver.ThreadingTCPServer):
    """``search`` takes a query and a number of results and returns JSON-ready rows."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, address: tuple[str, int], search: Callable[[str, int], list[dict]]):
        super().__init__(address, _Handler)
        self.search, self.began, self.served = search, time.time(), 0


class _Handler(socketserver.BaseRequestHandler):
    server: SearchServer

    def handle(self) -> None:
        try:
            asked = receive_frame(self.request)
            send_frame(self.request, self.answer(asked))
        except (ValueError, ConnectionError) as e:
            send_frame(self.request, {"success": False, "error": str(e)})

    def answer(self, asked: dict) -> dict:
        if asked.get("command") == "shutdown":
            # shutdown() waits for the serving loop, which this thread is not part of
            self.server.shutdown()
            return {"success": True, "message": "Server shutting down"}
        if asked.get("command") == "status":
            return {"success": True, "status": "ready", "query_count": self.server.served, "uptime": int(time.time() - self.server.began)}
        began = time.time()
        try:
            rows = self.server.search(str(asked["query"]), int(asked.get("top_k", 10)))
        except Exception as e:  # noqa: BLE001  a failed query is an answer
            return {"success": False, "error": str(e)}
        self.server.served += 1
        return {"success": True, "query": asked["query"], "count": len(rows), "search_time_ms": int(1000 * (time.time() - began)), "results": rows}


def ask(address: tuple[str, int], message: dict, timeout: float = 60.0) -> dict:
    with socket.create_connection(address, timeout) as sock:
        send_frame(sock, message)
        return receive_frame(sock)
