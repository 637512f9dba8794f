"""Scenes and the persona: driver-side runs around a model, over a folder of Markdown files.

These handle tens of files, so they run on the driver through Arrow's filesystems; queries
over scenes are in :mod:`palimpsest.sources.files`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyarrow import fs as pafs

from ..sources.files import INDEX, META_END, META_START

KEEP_BACKUPS = 10
_SIGNAL = re.compile(r"\[PERSONA_UPDATE(?::\s*(.*?))?\]", re.S)


@dataclass
class Scene:
    filename: str
    summary: str
    heat: int
    created: str
    updated: str
    body: str

    @classmethod
    def parse(cls, filename: str, raw: str) -> Scene:
        """By the rules of :func:`palimpsest.sources.files.parse_scenes`."""
        a, b = raw.find(META_START), raw.find(META_END)
        if a < 0 or b < a:
            return cls(filename, "", 0, "", "", raw.strip())
        lines = raw[a + len(META_START) : b].strip().splitlines()
        field = lambda name: next((x[len(name) + 1 :].strip() for x in lines if x.startswith(f"{name}:")), "")
        heat = field("heat")
        return cls(filename, field("summary"), int(heat) if re.fullmatch(r"[+-]?\d+", heat) else 0, field("created"), field("updated"), raw[b + len(META_END) :].strip())


def normal_name(name: str) -> str:
    """A safe Markdown file name, as the column function makes it."""
    base = re.sub(r"(?i)\.md$", "", re.split(r"[/\\]", name)[-1])
    base = re.sub(r"[<>:\"/\\|?*\x00-\x1f]", "", re.sub(r"\s+", "-", base))
    base = re.sub(r"^[-_.]+|[-_.]+$", "", re.sub(r"([-_.])\1+", r"\1", base))
    return f"{base or 'scene'}.md"


class Folder:
    """A memory folder's scenes, index, persona and their backups."""

    def __init__(self, path: str):
        self.fs, self.base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.fs.create_dir(f"{self.base}/scene_blocks", recursive=True)

    def _read(self, path: str) -> str | None:
        if self.fs.get_file_info(f"{self.base}/{path}").type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(f"{self.base}/{path}") as f:
            return f.read().decode("utf-8", "replace")

    def _write(self, path: str, text: str) -> None:
        """Write beside the file, then move it into place."""
        with self.fs.open_output_stream(f"{self.base}/{path}.tmp") as f:
            f.write(text.encode())
        self.fs.move(f"{self.base}/{path}.tmp", f"{self.base}/{path}")

    def names(self, folder: str = "scene_blocks") -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.base}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".md"))

    def scenes(self) -> list[Scene]:
        return [Scene.parse(n, self._read(f"scene_blocks/{n}") or "") for n in self.names()]

    def clean(self) -> int:
        """Remove scenes that are blank, marked as deleted, or without a body; how many."""
        gone = 0
        for n in self.names():
            raw = self._read(f"scene_blocks/{n}") or ""
            if raw.strip() in ("", "[DELETED]") or not Scene.parse(n, raw).body.strip():
                self.fs.delete_file(f"{self.base}/scene_blocks/{n}")
                gone += 1
        return gone

    def rename(self) -> dict[str, str]:
        """Give files normal names; a name in use gets -2, -3, … up to -999."""
        taken, out = set(self.names()), {}
        for n in self.names():
            want = normal_name(n)
            if want == n:
                continue
            stem, k = want[:-3], 2
            while want in taken and k < 1000:
                want, k = f"{stem}-{k}.md", k + 1
            if want in taken:
                raise ValueError(f"no free name for {n}")
            self.fs.move(f"{self.base}/scene_blocks/{n}", f"{self.base}/scene_blocks/{want}")
            taken = (taken - {n}) | {want}
            out[n] = want
        return out

    def write_index(self) -> list[dict]:
        index = [{k: getattr(s, k) for k in ("filename", "summary", "heat", "created", "updated")} for s in self.scenes()]
        self.fs.create_dir(f"{self.base}/.metadata", recursive=True)
        self._write(INDEX, json.dumps(index, ensure_ascii=False, indent=1))
        return index

    def navigation(self) -> str:
        lines = [f"- {s.filename} ({s.heat}) {s.summary}".rstrip() for s in sorted(self.scenes(), key=lambda s: -s.heat)]
        return "\n".join(["<scene-navigation>", *lines, "</scene-navigation>"]) if lines else ""

    def persona(self) -> str:
        """The persona's body, without its navigation."""
        return re.sub(r"(?s)\n*<scene-navigation>.*$", "", self._read("persona.md") or "").strip()

    def write_persona(self, body: str) -> None:
        self._write("persona.md", "\n\n".join(x for x in (body.strip(), self.navigation()) if x) + "\n")

    def backup(self, stamp: str, keep: int = KEEP_BACKUPS) -> str:
        """Copy all scenes to a folder named by ``stamp``; the newest ``keep`` by name stay."""
        to = f".backup/scene_blocks/{stamp}"
        self.fs.create_dir(f"{self.base}/{to}", recursive=True)
        for n in self.names():
            self.fs.copy_file(f"{self.base}/scene_blocks/{n}", f"{self.base}/{to}/{n}")
        held = sorted(f.base_name for f in self.fs.get_file_info(pafs.FileSelector(f"{self.base}/.backup/scene_blocks")) if not f.is_file)
        for old in held[:-keep] if keep else held:
            self.fs.delete_dir(f"{self.base}/.backup/scene_blocks/{old}")
        return to

    def restore(self, backup: str) -> None:
        self.fs.delete_dir_contents(f"{self.base}/scene_blocks")
        for n in self.names(backup):
            self.fs.copy_file(f"{self.base}/{backup}/{n}", f"{self.base}/scene_blocks/{n}")


def persona_signal(answer: str) -> str | None:
    """The reason of an answer that asks for a new persona, '' without one; None if it does not."""
    found = _SIGNAL.search(answer)
    return None if not found else (found[1] or "").strip()


def extract_scenes(folder: Folder, memories: list[dict], model: Callable[[list[dict], list[Scene], Callable[[str, str], None]], str], stamp: str) -> str | None:
    """Let a model rewrite scenes by the tool it is given, tidy up, and return its persona signal.

    The tool writes a scene's text by name.  If the run fails, scenes are as before."""
    held = folder.backup(stamp)
    try:
        answer = model(memories, folder.scenes(), lambda name, text: folder._write(f"scene_blocks/{normal_name(name)}", text))
        folder.clean()
        folder.rename()
        folder.write_index()
        if folder.persona():
            folder.write_persona(folder.persona())
        return persona_signal(answer)
    except Exception:
        folder.restore(held)
        raise


def changed(scene: Scene, since: str) -> bool:
    """Updated after a time; true if either time cannot be read."""
    try:
        return datetime.fromisoformat(scene.updated) > datetime.fromisoformat(since)
    except (ValueError, TypeError):
        return True


def generate_persona(folder: Folder, model: Callable[[str, list[Scene], str], str], since: str = "", reason: str = "") -> bool:
    """Write a persona from the scenes changed since the last one; False if none changed or
    the model has nothing to say."""
    found = [s for s in folder.scenes() if changed(s, since)]
    if not found:
        return False
    body = model(folder.persona(), found, reason)
    if not body.strip():
        return False
    folder.write_persona(re.sub(r"</?(relevant-memories|user-persona|scene-navigation|memory-tools-guide)>", lambda m: m[0].replace("<", "&lt;").replace(">", "&gt;"), body))
    return True
