"""Client of the public REST catalog protocol for snapshot tables."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lithic.operators.predicate import Predicate
from lithic.sources.snapshots import SnapshotTable

#: Levels of a namespace are joined by this character in paths (a fixed value of the protocol).
LEVELS = "\x1f"


class CatalogError(Exception):
    pass


@dataclass
class Catalog:
    """``credential`` is client:secret for a token by OAuth2; ``token`` a bearer token that is there already."""

    uri: str
    token: str | None = None
    credential: str | None = None
    scope: str = "catalog"
    warehouse: str | None = None
    timeout: float = 30.0
    _prefix: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if urllib.parse.urlparse(self.uri).scheme not in ("http", "https"):
            raise ValueError("a catalog is reached by http or https")
        self.uri = self.uri.rstrip("/")

    def _call(self, path: str, form: dict | None = None, headers: dict | None = None) -> dict:
        body = urllib.parse.urlencode(form).encode() if form else None
        request = urllib.request.Request(f"{self.uri}/v1/{path}", body, {"Accept": "application/json"} | (headers or {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise CatalogError(f"{e.code} from {path.split('?')[0]}") from e
        except (urllib.error.URLError, ValueError) as e:
            raise CatalogError(f"no answer from {path.split('?')[0]}") from e

    def _get(self, path: str, headers: dict | None = None) -> dict:
        if self.token is None and self.credential:
            client, _, secret = self.credential.partition(":")
            self.token = self._call("oauth/tokens", {"grant_type": "client_credentials", "client_id": client, "client_secret": secret, "scope": self.scope})["access_token"]
        own = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        if self._prefix is None:
            query = f"?warehouse={urllib.parse.quote(self.warehouse, safe='')}" if self.warehouse else ""
            got = self._call(f"config{query}", headers=own)
            prefix = (got.get("defaults", {}) | got.get("overrides", {})).get("prefix", "")
            self._prefix = f"{prefix.strip('/')}/" if prefix else ""
        return self._call(self._prefix + path, headers=own | (headers or {}))

    def _pages(self, path: str, key: str) -> list:
        out, token = [], ""
        while True:
            got = self._get(f"{path}?pageToken={urllib.parse.quote(token, safe='')}" if token else path)
            out += got.get(key, [])
            token = got.get("next-page-token") or ""
            if not token:
                return out

    @staticmethod
    def _quoted(namespace: str) -> str:
        return urllib.parse.quote(LEVELS.join(namespace.split(".")), safe="")

    def namespaces(self) -> list[str]:
        return [".".join(n) for n in self._pages("namespaces", "namespaces")]

    def tables(self, namespace: str) -> list[str]:
        return [t["name"] for t in self._pages(f"namespaces/{self._quoted(namespace)}/tables", "identifiers")]

    def load(self, namespace: str, table: str, vended: bool = False) -> dict:
        """The catalog's answer: metadata-location, config and, if asked for, credentials that it lends."""
        ask = {"X-Iceberg-Access-Delegation": "vended-credentials"} if vended else None
        return self._get(f"namespaces/{self._quoted(namespace)}/tables/{urllib.parse.quote(table, safe='')}", ask)

    def location(self, namespace: str, table: str) -> str:
        return self.load(namespace, table)["metadata-location"]

    def scan(self, spark: SparkSession, namespace: str, table: str, predicate: Predicate | None = None) -> DataFrame:
        return SnapshotTable(spark, self.location(namespace, table)).scan(predicate)
