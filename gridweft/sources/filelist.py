"""File lists: sources, include folders, defines and libraries, with nested lists."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

MAX_NESTING = 10


@dataclass
class FileList:
    sources: list[str] = field(default_factory=list)
    include_dirs: list[str] = field(default_factory=list)
    defines: list[str] = field(default_factory=list)
    library_dirs: list[str] = field(default_factory=list)
    library_files: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    def arguments(self) -> list[str]:
        return [*(f"-I{d}" for d in self.include_dirs), *(f"-D{d}" for d in self.defines), *(x for d in self.library_dirs for x in ("-y", d)), *self.sources]


def parse_filelist(path: str) -> FileList:
    """A list resolves its paths against its own folder."""
    out = FileList()
    _read(path, os.path.dirname(os.path.abspath(path)), out, 0)
    return out


def parse_text(text: str, base: str) -> FileList:
    out = FileList()
    _take(text, base, out, 0)
    return out


def _read(path: str, base: str, out: FileList, level: int) -> None:
    if level > MAX_NESTING:
        out.problems.append(f"{path}: nested too deeply")
        return
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
    except OSError:
        out.problems.append(f"{path}: can't be read")
        return
    _take(text, base, out, level)


def _take(text: str, base: str, out: FileList, level: int) -> None:
    words = [w for line in text.splitlines() for w in line.split("//")[0].split("#")[0].split()]
    at = lambda p, b=base: os.path.normpath(os.path.join(b, p))
    k = 0
    while k < len(words):
        w = words[k]
        value = words[k + 1] if k + 1 < len(words) else ""
        if w.startswith("+incdir+"):
            out.include_dirs += [at(p) for p in w[8:].split("+") if p]
        elif w.startswith("+define+"):
            out.defines += [d for d in w[8:].split("+") if d]
        elif w.startswith("+libext+"):
            out.extensions += [e for e in w[8:].split("+") if e]
        elif w in ("-f", "-F", "-y", "-v") and value:
            k += 1
            if w == "-y":
                out.library_dirs.append(at(value))
            elif w == "-v":
                out.library_files.append(at(value))
            else:
                # -f resolves nested paths against the working folder, -F against the nested list
                nested = at(value, os.getcwd() if w == "-f" else base)
                _read(nested, os.getcwd() if w == "-f" else os.path.dirname(nested), out, level + 1)
        elif not w.startswith(("+", "-")):
            out.sources.append(at(w))
        k += 1
