"""Which local paths the command line accepts."""

from __future__ import annotations

import os

#: Folders whose files are refused. Fixed values.
REFUSED = ("/etc/", "/sys/", "/proc/", "/dev/", "/boot/", "/root/")


def is_safe(path: str, refused: tuple[str, ...] = REFUSED) -> bool:
    """Whether a path may be opened: no step upwards, no line break, no symbolic link, not below a refused folder.

    A path that doesn't exist yet is judged by its folder.
    """
    if not path or "\0" in path or "\n" in path or "\r" in path or len(path) >= 4096:
        return False
    if path == ".." or "../" in path or "..\\" in path or os.path.islink(path):
        return False
    place = path if os.path.exists(path) else os.path.dirname(path) or "."
    if not os.path.exists(place) or os.path.islink(place):
        return False
    return not (os.path.realpath(place) + "/").startswith(refused)
