"""Model files: manifests, local look-up, and download by a function of the caller's."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class ModelManifest:
    """file name: address of each file; ``needed`` must be there for a folder to count."""

    id: str
    files: tuple[tuple[str, str], ...]


def resolve_local(folders: Iterable[str], manifest: ModelManifest, there: Callable[[str], bool] = os.path.isfile) -> dict[str, str] | None:
    """Paths by file name in the first folder that has all of the files; ``there`` says whether a file exists."""
    for folder in folders:
        paths = {n: os.path.join(folder, n) for n, _ in manifest.files} if folder and folder.strip() else None
        if paths and all(map(there, paths.values())):
            return paths
    return None


def ensure_downloaded(fetch: Callable[[str], bytes], folder: str, manifest: ModelManifest) -> dict[str, str]:
    """Fetches what isn't there; a file appears under its name only when whole."""
    os.makedirs(folder, exist_ok=True)
    out = {}
    for name, url in manifest.files:
        out[name] = path = os.path.join(folder, name)
        if not os.path.isfile(path):
            data = fetch(url)
            with open(path + ".part", "wb") as f:
                f.write(data)
            os.replace(path + ".part", path)
    return out


def ensure_available(fetch: Callable[[str], bytes], folder: str, folders: Iterable[str], manifest: ModelManifest) -> dict[str, str]:
    return resolve_local(folders, manifest) or ensure_downloaded(fetch, folder, manifest)
