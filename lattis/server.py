"""Sessions over TCP: a command ends with a NUL byte or a semicolon, an answer with a NUL byte.

Queries are answered with the client's table, other statements with nothing, "failure" or "abort"; the output file has
the plain lines. One thread serves a connection; all of them share the database and Spark.

    python -m lattis.server FOLDER [PORT]
"""

from __future__ import annotations

import socketserver
import sys
import threading

from lattis.plans.dialect import split
from lattis.session import Session
from lattis.sources.storage import Database

PORT = 8765
LONGEST = 1 << 20


def commands(receive):
    """The commands in a byte stream; receive() gives its next bytes, none at the end."""
    held = b""
    while True:
        parts = held.split(b"\0")
        for part in parts[:-1]:
            if part.strip():
                yield part.decode("utf-8", "replace")
        held = parts[-1]
        if held.rstrip().endswith(b";") and held.count(b"'") % 2 == 0:  # not within a string
            yield from (s.strip() for s in split(held.decode("utf-8", "replace")))
            held = b""
        if len(held) > LONGEST:
            raise ValueError("the command is too long")
        more = receive()
        if not more:
            return
        held += more


class _Handler(socketserver.BaseRequestHandler):
    def handle(self) -> None:
        session = Session(self.server.database, self.server.output)
        try:
            for text in commands(lambda: self.request.recv(65536)):
                self.request.sendall(self.answer(session, text).encode() + b"\0")
                if session.closed:
                    break
        except (ValueError, OSError):
            pass
        finally:
            session.close()

    @staticmethod
    def answer(session: Session, text: str) -> str:
        result, said = session.answer(text)
        return result.table() + "\n" if result and result.query else said


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, database: Database, port: int = PORT, output: str | None = None, host: str = "127.0.0.1"):
        self.database, self.output = database, output
        super().__init__((host, port), _Handler)

    def start(self) -> threading.Thread:
        thread = threading.Thread(target=self.serve_forever, daemon=True)
        thread.start()
        return thread


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lattis").getOrCreate()
    server = Server(Database(spark, argv[0]), int(argv[1]) if len(argv) > 1 else PORT, f"{argv[0]}/output.txt")
    server.serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
