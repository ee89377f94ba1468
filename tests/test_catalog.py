import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lithic.sources.catalog import Catalog, CatalogError

ANSWERS = {
    "/v1/config?warehouse=w%2F1": {"overrides": {"prefix": "p"}},
    "/v1/p/namespaces": {"namespaces": [["a"], ["a", "b"]], "next-page-token": "2"},
    "/v1/p/namespaces?pageToken=2": {"namespaces": [["c"]]},
    "/v1/p/namespaces/a%1Fb/tables": {"identifiers": [{"namespace": ["a", "b"], "name": "t"}]},
    "/v1/p/namespaces/a%1Fb/tables/t": {"metadata-location": "file:///m.json", "config": {"k": "v"}},
}


class Stub(BaseHTTPRequestHandler):
    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        form = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self.answer(*((200, {"access_token": "T"}) if self.path == "/v1/oauth/tokens" and "client_id=me" in form and "client_secret=s" in form else (401, {})))

    def do_GET(self):
        ok = self.headers.get("Authorization") == "Bearer T" and self.path in ANSWERS
        self.answer(*((200, ANSWERS[self.path]) if ok else (404, {})))

    def log_message(self, *args):
        pass


@pytest.fixture
def uri():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_catalog(uri):
    c = Catalog(uri, credential="me:s", warehouse="w/1")
    assert c.namespaces() == ["a", "a.b", "c"] and c.tables("a.b") == ["t"] and c.location("a.b", "t") == "file:///m.json"
    assert c.load("a.b", "t", vended=True)["config"] == {"k": "v"}
    with pytest.raises(CatalogError):
        c.load("a.b", "missing")


def test_refusals(uri):
    with pytest.raises(CatalogError):
        Catalog(uri, credential="me:wrong", warehouse="w/1").namespaces()
    with pytest.raises(ValueError):
        Catalog("file:///etc")
    with pytest.raises(CatalogError):
        Catalog("http://127.0.0.1:9", timeout=1).namespaces()
