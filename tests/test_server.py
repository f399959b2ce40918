import socket

import pytest

from lattis.server import Server, commands
from lattis.sources.storage import Database


@pytest.fixture
def server(spark, tmp_path):
    s = Server(Database(spark, str(tmp_path / "db")), 0, str(tmp_path / "output.txt"))
    s.start()
    yield s
    s.shutdown()
    s.server_close()


class Client:
    def __init__(self, server):
        self.sock = socket.create_connection(server.server_address, 30)

    def ask(self, text, end=b"\0"):
        self.sock.sendall(text.encode() + end)
        got = b""
        while not got.endswith(b"\0"):
            got += self.sock.recv(4096)
        return got[:-1].decode()


def test_two_clients(server, tmp_path):
    a, b = Client(server), Client(server)
    assert a.ask("create table t (id int, c char(30));") == "" and a.ask("insert into t values (1, 'a text of over sixteen bytes');") == ""
    assert "a text of ove..." in b.ask("select * from t;") and "Total record(s): 1" in b.ask("select * from t;", b"")
    a.ask("begin;")
    a.ask("update t set c = 'x' where id = 1;")
    b.ask("begin;")
    assert b.ask("delete from t;") == "abort\n" and b.ask("select * from u;") == "failure\n"
    a.sock.close()  # rolled back
    assert "a text of ove" in Client(server).ask("select * from t;")
    assert "| 1 | a text of over sixteen bytes |" in (tmp_path / "output.txt").read_text()


def test_commands_in_pieces():
    stream = iter([b"sele", b"ct 1;", b"a\0b", b"\0 \0insert 'x;", b"y';", b""])
    assert list(commands(lambda: next(stream))) == ["select 1;", "a", "b", "insert 'x;y';"]
