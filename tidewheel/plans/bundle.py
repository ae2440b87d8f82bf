"""Job bundles: a zip of a job document and its Python modules, with a manifest of digests."""

from __future__ import annotations

import hashlib
import json
import sys
import zipfile
from pathlib import Path, PurePosixPath

from . import spec

MANIFEST, JOBS = "manifest.json", ("job.yaml", "job.yml", "job.json")
MOST_BYTES = 64 << 20


class BundleError(ValueError):
    """A bundle that can't be built or trusted."""


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _job_of(names) -> str:
    found = [n for n in JOBS if n in names]
    if len(found) != 1:
        raise BundleError(f"needs exactly one of {', '.join(JOBS)}")
    return found[0]


def build(folder: Path, out: Path) -> Path:
    """Pack the folder's job and modules; the file is named by its content, and equal content gives an equal file."""
    files = {}
    for path in sorted(folder.rglob("*")):
        name = path.relative_to(folder).as_posix()
        if path.is_symlink():
            raise BundleError(f"{name} is a link")
        if path.is_file() and (path.suffix == ".py" or name in JOBS) and not any(p.startswith(".") or p == "__pycache__" for p in PurePosixPath(name).parts):
            files[name] = path.read_bytes()
    job = spec.load(files[_job_of(files)].decode("utf-8"))
    manifest = json.dumps({"job": job.name, "files": {n: _digest(d) for n, d in files.items()}}, sort_keys=True).encode()
    target = out / f"{job.name}-{_digest(manifest)[:16]}.zip"
    out.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [*files.items(), (MANIFEST, manifest)]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return target


def read(path: Path) -> spec.Job:
    """The job of a bundle whose every file is named safely and has the manifest's digest."""
    with zipfile.ZipFile(path) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise BundleError("is too large")
        names = z.namelist()
        if len(set(names)) < len(names) or any(PurePosixPath(n).is_absolute() or ".." in PurePosixPath(n).parts or "\\" in n for n in names):
            raise BundleError("has repeated or unsafe names")
        files = {n: z.read(n) for n in names}
    try:
        listed = json.loads(files.pop(MANIFEST))["files"]
    except (KeyError, ValueError, TypeError) as e:
        raise BundleError("has no manifest") from e
    if listed != {n: _digest(d) for n, d in files.items()}:
        raise BundleError("differs from its manifest")
    return spec.load(files[_job_of(files)].decode("utf-8"))


def ship(spark, path: Path) -> None:
    """Make the bundle's modules importable here and on every executor; only trusted bundles should be run."""
    spark.sparkContext.addPyFile(str(path))
    if str(path) not in sys.path:
        sys.path.insert(0, str(path))
