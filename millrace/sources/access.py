"""Which paths may be read and written, and the settings of remote stores."""

from __future__ import annotations

from dataclasses import dataclass, field
from posixpath import normpath
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


class AccessDenied(PermissionError):
    """A path outside of what the policy allows."""


@dataclass
class AccessPolicy:
    """external: may files be used at all; allowed_directories: if not empty, only what is below them; disabled:
    schemes of file systems that may not be used ("" and "file" are the local one). Empty list entries don't count."""

    external: bool = True
    allowed_directories: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)

    def check(self, path: str) -> str:
        if not self.external:
            raise AccessDenied(f"access to files is disabled: {path}")
        parts = urlsplit(path)
        scheme = parts.scheme if len(parts.scheme) > 1 else ""
        local = scheme in ("", "file")
        if scheme in self.disabled or (local and {"", "file", "LocalFileSystem"} & {d for d in self.disabled if d}):
            raise AccessDenied(f"the file system of {path} is disabled")
        folders = [d for d in self.allowed_directories if d.strip()]
        if folders and not any(_below(path, folder) for folder in folders):
            raise AccessDenied(f"{path} is not in an allowed directory")
        return path


def _plain(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return normpath(parts.path if parts.scheme else path)
    return f"{parts.scheme}://{parts.netloc}{normpath(parts.path or '/')}"


def _below(path: str, folder: str) -> bool:
    path, folder = _plain(path), _plain(folder)
    return path == folder or path.startswith(folder.rstrip("/") + "/")


OPEN = AccessPolicy()


def configure_store(spark: SparkSession, kind: str, **values: str) -> dict[str, str]:
    """Set a remote store's keys on the session: kind "s3" (also gcs and r2, by endpoint) or "azure". Settings of a running
    session reach its file systems under their own names; file systems that are already open keep theirs."""
    names = {
        "s3": {"key_id": "fs.s3a.access.key", "secret": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "region": "fs.s3a.endpoint.region", "endpoint": "fs.s3a.endpoint", "url_style": "fs.s3a.path.style.access", "use_ssl": "fs.s3a.connection.ssl.enabled"},
        "azure": {"account": "", "account_key": "fs.azure.account.key.{account}.dfs.core.windows.net"},
    }[kind]
    out = {}
    for key, value in values.items():
        if key not in names:
            raise ValueError(f"unknown setting of a {kind} store: {key}")
        if names[key]:
            out[names[key].format(**values)] = ("true" if value == "path" else "false") if key == "url_style" else value
    for key, value in out.items():
        spark.conf.set(key, value)
    return out
