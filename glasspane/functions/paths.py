"""Which directories must not be deleted, by rules over their paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of the system, and the users' folders below them.
SYSTEM = ("c:/windows", "c:/program files", "c:/program files (x86)", "c:/programdata", "/usr", "/etc", "/bin", "/sbin", "/var", "/boot", "/private/etc", "/private/var")
USERS = ("/var/folders/", "/private/var/folders/")


def last_name(path: Column) -> Column:
    """The last element of a path; separators behind it do not count."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def refusal(path: Column, confirmation: Column, home: Column, is_directory: Column, is_link: Column, has_repository: Column) -> Column:
    """Why an absolute path is not deleted with all below it, or null; the first rule that holds counts.

    The confirmation must be the directory's name. Links are never followed, so
    one is refused whatever it leads to.
    """
    plain = lambda p: F.regexp_replace(p, r"[/\\]+$", "")
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    below = [(F.regexp_replace(low, "/+$", "") == s) | F.startswith(low, F.lit(s + "/")) for s in SYSTEM]
    system = F.lit(False)
    for b in below:
        system = system | b
    exempt = F.startswith(low, F.lit(USERS[0])) | F.startswith(low, F.lit(USERS[1]))
    return (
        F.when(is_link, "link")
        .when(~is_directory, "not a directory")
        .when(F.rlike(path, F.lit(r"^([A-Za-z]:)?[/\\]+$")), "drive root")
        .when((home != "") & (plain(path) == plain(home)), "home directory")
        .when(system & ~exempt, "system directory")
        .when(has_repository, "contains a repository")
        .when(confirmation != last_name(path), "name does not match")
    )
