"""Package keys: purls, CPEs and the URL and path shapes that name them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of package registries and their ecosystems.
REGISTRY_HOSTS = {
    "crates.io": "cargo", "static.crates.io": "cargo", "pypi.org": "pypi", "files.pythonhosted.org": "pypi", "registry.npmjs.org": "npm",
    "proxy.golang.org": "golang", "sum.golang.org": "golang", "repo1.maven.org": "maven", "repo.maven.apache.org": "maven", "central.maven.org": "maven",
    "rubygems.org": "gem", "deb.debian.org": "deb", "security.debian.org": "deb", "archive.ubuntu.com": "deb", "security.ubuntu.com": "deb",
}

#: Hosts that are looked for inside a payload, in this order; the first one found counts.
PROBE_HOSTS = (
    "static.crates.io crates.io index.crates.io files.pythonhosted.org pypi.org registry.npmjs.org proxy.golang.org sum.golang.org "
    "repo1.maven.org repo.maven.apache.org central.maven.org rubygems.org deb.debian.org security.debian.org archive.ubuntu.com "
    "security.ubuntu.com ports.ubuntu.com"
).split()

#: Code names of releases that archive paths may hold.
CODENAMES = {"debian": "trixie bookworm bullseye buster stretch".split(), "ubuntu": "noble mantic lunar kinetic jammy focal bionic".split()}

#: Rpm vendors by os-release id; other ids stand for themselves.
RPM_VENDORS = {"rhel": "redhat", "ol": "oracle", "amzn": "amazon", "opensuse-leap": "opensuse", "opensuse-tumbleweed": "opensuse", "sles": "suse"}


def purl_segment(x: Column) -> Column:
    """`+` as %2B, whether it was encoded before or not."""
    return F.replace(F.regexp_replace(x, "%2[bB]", "+"), F.lit("+"), F.lit("%2B"))


def sorted_qualifiers(x: Column) -> Column:
    """k=v pairs joined by &, in order of their keys."""
    pairs = F.transform(F.split(x, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["p"]), "&")


def purl(kind: Column, namespace: Column | None, name: Column, version: Column) -> Column:
    parts = [F.lit("pkg:"), kind, F.lit("/")]
    if namespace is not None:
        parts.append(F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(purl_segment(namespace), F.lit("/"))).otherwise(""))
    return F.concat(*parts, purl_segment(name), F.lit("@"), purl_segment(version))


def purl_parts(x: Column) -> Column:
    """A struct of type, namespace, name, version and qualifiers."""
    body = F.substring_index(x, "?", 1)
    at = F.regexp_extract(body, r"^pkg:([^/]+)/(?:(.*)/)?([^/@]+)(?:@(.*))?$", 4)
    group = lambda k: F.regexp_extract(body, r"^pkg:([^/]+)/(?:(.*)/)?([^/@]+)(?:@(.*))?$", k)
    return F.struct(group(1).alias("type"), group(2).alias("namespace"), group(3).alias("name"), at.alias("version"), F.when(F.instr(x, "?") > 0, F.substring_index(x, "?", -1)).otherwise("").alias("qualifiers"))


def cpe_escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([^A-Za-z0-9._-])", r"\\$1")


def cpe(vendor: Column, product: Column, version: Column) -> Column:
    return F.concat(F.lit("cpe:2.3:a:"), cpe_escape(F.lower(vendor)), F.lit(":"), cpe_escape(product), F.lit(":"), cpe_escape(version), F.lit(":*:*:*:*:*:*:*"))


def registry_of(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for h, kind in REGISTRY_HOSTS.items():
        out = F.when(F.lower(host) == h, F.lit(kind)).otherwise(out)
    return out


def _found(x: Column, pattern: str, make) -> Column:
    return F.when(x.rlike(pattern), make(lambda k: F.regexp_extract(x, pattern, k)))


def url_key(path: Column) -> Column:
    """The purl that the path of a registry URL names: the first of cargo, pypi, npm, golang, gem; else null."""
    return F.coalesce(
        _found(path, r"/crates/([^/]+)/[^/]+-([0-9][^/]*)\.crate$", lambda g: purl(F.lit("cargo"), None, g(1), g(2))),
        _found(path, r"/api/v1/crates/([^/]+)/([^/]+)/", lambda g: purl(F.lit("cargo"), None, g(1), g(2))),
        _found(path, r"^/packages/.*/([^/]+?)-([0-9][^/-]*?)(?:-[^/]*)?(?:\.tar\.gz|\.whl|\.zip)$", lambda g: purl(F.lit("pypi"), None, F.translate(F.lower(g(1)), "-.", "__"), g(2))),
        _found(path, r"^/(@[^/]+)/([^/]+)/-/[^/]+-([0-9][^/]*)\.tgz$", lambda g: purl(F.lit("npm"), F.replace(g(1), F.lit("@"), F.lit("%40")), g(2), g(3))),
        _found(path, r"^/([^/@]+)/-/[^/]+-([0-9][^/]*)\.tgz$", lambda g: purl(F.lit("npm"), None, g(1), g(2))),
        _found(path, r"^/(.+)/@v/([^/]+)\.(?:zip|mod|info|ziphash)$", lambda g: purl(F.lit("golang"), None, g(1), g(2))),
        _found(path, r"^/(?:gems|downloads)/(.+)-([0-9][^/-]*)\.gem$", lambda g: purl(F.lit("gem"), None, g(1), g(2))),
    )


def maven_url(path: Column) -> Column:
    """pkg:maven of group/path/artifact/version/artifact-version..., below /maven2/ or /maven/ if there."""
    parts = F.filter(F.split(F.regexp_replace(path, "^/maven2?/", "/"), "/"), lambda x: x != "")
    last = lambda k: F.try_element_at(parts, F.lit(-k))
    group = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 3, F.lit(0))), ".")
    return F.when((F.size(parts) >= 4) & F.startswith(last(1), F.concat(last(3), F.lit("-"), last(2))), purl(F.lit("maven"), group, last(3), last(2)))


def deb_url(host: Column, path: Column, codename: Column | None = None) -> Column:
    """pkg:deb of a pool path name_version_arch.deb; the code name is given or found in the path."""
    distro = F.when(F.endswith(host, F.lit("debian.org")), "debian").otherwise("ubuntu")
    pool = F.when(F.instr(path, "/pool/") > 0, F.regexp_replace(path, "^.*?/pool/", ""))
    parts = F.split(F.regexp_extract(F.substring_index(pool, "/", -1), r"^(.*)\.u?deb$", 1), "_", 3)
    found = F.coalesce(*(F.when((distro == d) & F.contains(F.lower(path), F.lit(n)), F.lit(n)) for d, names in CODENAMES.items() for n in names))
    found = found if codename is None else F.coalesce(codename, found)
    own = F.concat(F.lit("pkg:deb/"), distro, F.lit("/"), purl_segment(F.get(parts, 0)), F.lit("@"), purl_segment(F.get(parts, 1)), F.lit("?arch="), F.get(parts, 2))
    return F.when((F.size(F.split(pool, "/")) >= 4) & (F.size(parts) == 3), F.concat(own, F.coalesce(F.concat(F.lit("&distro="), found), F.lit(""))))


def resolved_url(host: Column, path: Column, codename: Column | None = None) -> Column:
    """The purl that a registry's URL names, by the host's ecosystem; else null."""
    kind = registry_of(host)
    named = F.when(F.startswith(url_key(path), F.concat(F.lit("pkg:"), kind, F.lit("/"))), url_key(path))
    return F.coalesce(F.when(kind == "maven", maven_url(path)), F.when(kind == "deb", deb_url(host, path, codename)), F.when(~kind.isin("maven", "deb"), named))


def probed_host(payload: Column) -> Column:
    """The first of PROBE_HOSTS that the payload holds anywhere."""
    return F.coalesce(*(F.when(F.instr(payload, h) > 0, F.lit(h)) for h in PROBE_HOSTS))


def rpm_vendor(os_id: Column) -> Column:
    out = os_id
    for k, v in RPM_VENDORS.items():
        out = F.when(os_id == k, F.lit(v)).otherwise(out)
    return out


def _qualified(base: Column, *pairs: tuple[str, Column]) -> Column:
    """base with ?k=v&k=v of the values that are neither null nor empty."""
    text = F.array_join(F.filter(F.array(*(F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in pairs)), lambda x: x.isNotNull()), "&")
    return F.concat(base, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def package_purl(ecosystem: Column, name: Column, version: Column, *, arch: Column | None = None, distro: Column | None = None, vendor: Column | None = None, group: Column | None = None, epoch: Column | None = None) -> Column:
    """The canonical purl of a package of one of nine ecosystems (null for others).

    deb and rpm take the vendor as namespace, deb and apk a distro version, maven a group; npm scopes are part of the name,
    pypi names are lower-cased with - for _ and may lack a version.
    """
    none = F.lit(None).cast("string")
    arch, distro, vendor, group, epoch = (none if x is None else x for x in (arch, distro, vendor, group, epoch))
    plain = lambda kind: purl(F.lit(kind), None, name, version)
    pypi = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
    scoped = F.concat(F.lit("pkg:npm/%40"), purl_segment(F.regexp_extract(name, "^@([^/]*)/", 1)), F.lit("/"), purl_segment(F.regexp_extract(name, "^@[^/]*/(.*)$", 1)), F.lit("@"), purl_segment(version))
    return (
        F.when(ecosystem == "deb", _qualified(purl(F.lit("deb"), vendor, name, version), ("arch", arch), ("distro", F.concat(vendor, F.lit("-"), F.when(distro != "", distro)))))
        .when(ecosystem == "apk", _qualified(purl(F.lit("apk"), F.lit("alpine"), name, version), ("arch", arch), ("distro", F.concat(F.lit("alpine-"), F.when(distro != "", distro)))))
        .when(ecosystem == "rpm", _qualified(purl(F.lit("rpm"), vendor, name, version), ("arch", arch), ("epoch", F.when(epoch != "0", epoch))))
        .when((ecosystem == "npm") & F.startswith(name, F.lit("@")), scoped)
        .when(ecosystem == "pypi", F.when(F.coalesce(version, F.lit("")) == "", F.concat(F.lit("pkg:pypi/"), purl_segment(pypi))).otherwise(purl(F.lit("pypi"), None, pypi, version)))
        .when(ecosystem == "maven", purl(F.lit("maven"), group, name, version))
        .when(ecosystem == "npm", plain("npm"))
        .when(ecosystem == "golang", plain("golang"))
        .when(ecosystem == "gem", plain("gem"))
        .when(ecosystem == "cargo", plain("cargo"))
    )


def purl_supplier(ecosystem: Column, namespace: Column) -> Column:
    """golang: host and organisation; maven: the group; npm: the scope; else null. An empty namespace is none."""
    space = F.nullif(namespace, F.lit(""))
    return F.when(ecosystem == "golang", F.substring_index(space, "/", 2)).when(ecosystem == "maven", space).when((ecosystem == "npm") & F.startswith(space, F.lit("@")), space)


def purl_vcs(ecosystem: Column, namespace: Column, name: Column) -> Column:
    """The repository URL of a golang module on a known host, else null."""
    parts = F.split(namespace, "/")
    known = (ecosystem == "golang") & (F.size(parts) >= 2) & F.get(parts, 0).isin("github.com", "gitlab.com", "bitbucket.org")
    return F.when(known, F.concat(F.lit("https://"), F.get(parts, 0), F.lit("/"), F.get(parts, 1), F.lit("/"), name))


def cpe_vendors(ecosystem: Column, namespace: Column, name: Column) -> Column:
    """Vendor candidates in order, lower-cased, distinct, without empty ones; none for unknown ecosystems."""
    space = F.nullif(namespace, F.lit(""))
    tail = F.substring_index(space, ".", -1)
    rules = {
        "deb": (F.lit("debian"), name), "apk": (F.lit("alpinelinux"), name), "rpm": (space, name), "gem": (name,), "cargo": (name,), "nuget": (name,),
        "npm": (name, F.regexp_replace(space, "^@+", "")), "pypi": (name, F.concat(F.lit("python-"), name)), "golang": (name, space), "go": (name, space),
        "maven": (space, F.when(tail != space, tail), name),
    }
    out = F.array().cast("array<string>")
    for kind, vendors in rules.items():
        out = F.when(ecosystem == kind, F.array(*vendors)).otherwise(out)
    return F.array_distinct(F.filter(F.transform(out, F.lower), lambda x: F.coalesce(x, F.lit("")) != ""))


def cpes(ecosystem: Column, namespace: Column, name: Column, version: Column) -> Column:
    """A CPE 2.3 string for each vendor candidate; none if name or version is empty."""
    some = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(version, F.lit("")) != "")
    return F.when(some, F.transform(cpe_vendors(ecosystem, namespace, name), lambda v: cpe(v, name, version))).otherwise(F.array().cast("array<string>"))


def cpe_sanitized(x: Column) -> Column:
    """Lower case with _ for every character but letters, digits, _, - and . of ASCII; _ for nothing."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(x), "[^a-z0-9_.-]", "_"), F.lit("")), F.lit("_"))


def module_escaped(path: Column) -> Column:
    """A module path with ! and the small letter for each capital of ASCII."""
    return F.lower(F.regexp_replace(path, "([A-Z])", "!$1"))


def base32_id(x: Column, length: int = 16) -> Column:
    """The first `length` base-32 characters of the sha256 of x: five bits each, read from pairs of hex digits."""
    def spelled(digest: Column) -> Column:
        chars = []
        for i in range(length):
            digit, bit = divmod(5 * i, 4)
            pair = F.conv(F.substring(digest, digit + 1, 2), 16, 10).cast("int")
            chars.append(F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(pair, 3 - bit).bitwiseAND(31) + 1, F.lit(1)))
        return F.concat(*chars)

    # a lambda's argument is computed once, however often it is used
    return F.transform(F.array(F.sha2(x, 256)), spelled)[0]


def _pnpm_name(x: Column) -> Column:
    """@scope+name of a pnpm store as %40scope/name; in names without scope the slash is encoded."""
    return F.when(x.startswith("@"), F.replace(F.replace(x, F.lit("+"), F.lit("/")), F.lit("@"), F.lit("%40"))).otherwise(F.replace(x, F.lit("+"), F.lit("%2F")))


def path_key(path: Column) -> Column:
    """The purl that a file's path names: cargo, pip, npm, go, deb; else null."""
    return F.coalesce(
        _found(path, r"/registry/cache/[^/]+/(.+)-([0-9]+\.[^/]*)\.crate$", lambda g: purl(F.lit("cargo"), None, g(1), g(2))),
        _found(path, r"(?:^|/)([^/-]+)-([0-9][^/-]*)(?:-[^/-]+){3,4}\.whl$", lambda g: purl(F.lit("pypi"), None, F.replace(F.lower(g(1)), F.lit("_"), F.lit("-")), g(2))),
        _found(path, r"(?:^|/)([^/]+)-([0-9][^/-]*)\.(?:dist-info|egg-info)(?:/|$)", lambda g: purl(F.lit("pypi"), None, F.replace(F.lower(g(1)), F.lit("_"), F.lit("-")), g(2))),
        _found(path, r"(?:^|/)([^/]+)-([0-9][^/]*)\.tgz$", lambda g: purl(F.lit("npm"), None, g(1), g(2))),
        _found(path, r"^.*?node_modules/\.pnpm/([^/]+)@([^/@]+)(?:/|$)", lambda g: F.concat(F.lit("pkg:npm/"), _pnpm_name(g(1)), F.lit("@"), purl_segment(g(2)))),
        _found(path, r"/pkg/mod/(?:cache/download/)?(.+)/@v/([^/]+)\.(?:zip|mod|info)$", lambda g: purl(F.lit("golang"), None, g(1), g(2))),
        _found(path, r"/pkg/mod/(.+)@(v[^/]+)(?:/|$)", lambda g: purl(F.lit("golang"), None, g(1), g(2))),
        _found(path, r"(?:^|/)([a-z0-9][a-z0-9+.-]+)_([^_/]+)_([a-z0-9]+)\.deb$", lambda g: F.concat(purl(F.lit("deb"), F.lit("debian"), g(1), F.replace(g(2), F.lit("%3a"), F.lit(":"))), F.lit("?arch="), g(3))),
    )
