"""Standard-library catalogues as relations.

Node's modules are stated below, as the runtime is not here to be asked. Python's and Java's are
built by rule from the running interpreter and virtual machine: the public names of a fixed list
of modules and packages.
"""

from __future__ import annotations

import importlib
import inspect
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.functions import paths
from symbolgrid.model import CLASS, ENUM, FUNCTION, INTERFACE, MODULE, MODULE_IMPORT, STANDARD_LIBRARY, VARIABLE

#: Module, the name it is imported under as a whole (-: none), its classes,
#: functions and variables.
NODE = """
node:assert/strict - | AssertionError | deepEqual equal fail notEqual ok rejects strictEqual |
node:buffer buffer | Buffer | |
node:child_process child_process | | exec execFile fork spawn |
node:cluster cluster | Worker | disconnect fork | isPrimary isWorker
node:crypto crypto | | createHash createHmac randomBytes randomUUID timingSafeEqual |
node:dns dns | | lookup resolve resolve4 resolve6 reverse |
node:dns/promises - | | lookup resolve resolve4 resolve6 reverse |
node:events events | EventEmitter | once on |
node:fs fs | | createReadStream createWriteStream existsSync mkdirSync readFileSync readdirSync statSync watch writeFileSync | promises
node:fs/promises - | | access cp mkdir readFile readdir rename rm stat writeFile |
node:http2 http2 | Http2ServerRequest Http2ServerResponse | connect createSecureServer createServer |
node:http http | IncomingMessage Server ServerResponse | createServer get request |
node:https https | | createServer get request |
node:os os | | arch cpus homedir hostname platform tmpdir userInfo | EOL
node:module module | Module | createRequire isBuiltin | builtinModules
node:net net | Server Socket | connect createConnection createServer |
node:path path | | basename dirname extname format join normalize parse relative resolve | delimiter sep
node:readline readline | Interface | createInterface |
node:readline/promises - | | createInterface |
node:process process | | cwd exit nextTick | argv env
node:querystring querystring | | escape parse stringify unescape |
node:stream stream | PassThrough Readable Transform Writable | finished pipeline |
node:stream/promises - | | finished pipeline |
node:stream/web - | ReadableStream TransformStream WritableStream | |
node:string_decoder string_decoder | StringDecoder | |
node:test test | | after before describe it test | mock
node:timers timers | | clearImmediate clearInterval clearTimeout setImmediate setInterval setTimeout |
node:timers/promises - | | setImmediate setInterval setTimeout |
node:tls tls | TLSSocket | connect createSecureContext createServer |
node:url url | URL URLSearchParams | fileURLToPath pathToFileURL |
node:util util | | debuglog inherits inspect promisify | types
node:v8 v8 | | deserialize getHeapStatistics serialize |
node:vm vm | Script SourceTextModule SyntheticModule | createContext runInContext runInNewContext |
node:worker_threads - | Worker | | isMainThread parentPort workerData
node:zlib zlib | | createGunzip createGzip gunzip gzip |
"""
#: Python modules of the catalogue; those with a dot have no import of their own.
PYTHON_MODULES = (
    "abc argparse asyncio collections collections.abc contextlib concurrent.futures configparser copy csv dataclasses datetime "
    "decimal enum email.message functools hashlib http.client http.server heapq inspect itertools json logging math os pathlib "
    "pprint queue random re shutil sqlite3 statistics subprocess sys tempfile threading time typing unittest unittest.mock "
    "urllib.parse urllib.request xml.etree.ElementTree uuid warnings weakref"
).split()
#: Java packages of the catalogue.
JAVA_PACKAGES = (
    "java.io java.math java.net java.lang.annotation java.lang.reflect java.net.http java.nio java.nio.channels java.nio.charset "
    "java.nio.file java.nio.file.attribute java.security java.sql java.text java.time java.time.format java.util "
    "java.util.concurrent java.util.concurrent.atomic java.util.concurrent.locks java.util.function java.util.regex "
    "java.util.stream java.util.jar java.util.zip javax.crypto javax.net.ssl javax.xml.parsers org.w3c.dom org.xml.sax"
).split()
SCHEMA = "language_key string, qualifier string, module_import string, name string, kind int, flags int"
EXTENSION = {"python": "py", "java": "java", "node": "ts"}


def node_modules() -> list[tuple]:
    rows = []
    for line in NODE.strip().splitlines():
        head, *groups = [part.split() for part in line.split("|")]
        module = None if head[1] == "-" else head[1]
        rows += [("node", head[0], module, n, kind, 0) for kind, names in zip((CLASS, FUNCTION, VARIABLE), groups, strict=True) for n in names]
    return rows


def python_modules(names: tuple[str, ...] | list[str] = tuple(PYTHON_MODULES)) -> list[tuple]:
    """Public names of modules, as far as they can be imported here."""
    rows = []
    for name in names:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                module = importlib.import_module(name)
        except ImportError:
            continue
        own = getattr(module, "__all__", None) or [n for n in vars(module) if not n.startswith("_")]
        for n in sorted(set(own)):
            value = getattr(module, n, None)
            if not inspect.ismodule(value):
                kind = CLASS if inspect.isclass(value) else FUNCTION if callable(value) else VARIABLE
                rows.append(("python", name, None if "." in name else name, n, kind, 0))
    return rows


def _each(stream) -> Iterator:
    entries = stream.iterator()
    while entries.hasNext():
        yield entries.next()


def java_packages(spark: SparkSession, names: tuple[str, ...] | list[str] = tuple(JAVA_PACKAGES)) -> list[tuple]:
    """Public top-level types of packages, as the session's virtual machine knows them."""
    jvm = spark._jvm
    image = jvm.java.nio.file.FileSystems.getFileSystem(jvm.java.net.URI.create("jrt:/"))
    none = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
    loader, rows = jvm.java.lang.ClassLoader.getSystemClassLoader(), []
    for package in names:
        found = set()
        for module in _each(jvm.java.nio.file.Files.newDirectoryStream(image.getPath(f"/packages/{package}", none))):
            folder = image.getPath(f"/modules/{module.getFileName().toString()}/{package.replace('.', '/')}", none)
            if jvm.java.nio.file.Files.isDirectory(folder, spark.sparkContext._gateway.new_array(jvm.java.nio.file.LinkOption, 0)):
                for entry in _each(jvm.java.nio.file.Files.newDirectoryStream(folder)):
                    stem = entry.getFileName().toString()
                    if stem.endswith(".class") and "$" not in stem and "-" not in stem:
                        found.add(stem.removesuffix(".class"))
        for name in sorted(found):
            type_ = jvm.java.lang.Class.forName(f"{package}.{name}", False, loader)
            if jvm.java.lang.reflect.Modifier.isPublic(type_.getModifiers()):
                rows.append(("java", package, None, name, INTERFACE if type_.isInterface() else ENUM if type_.isEnum() else CLASS, 0))
    return rows


def rows(spark: SparkSession) -> list[tuple]:
    return python_modules() + java_packages(spark) + node_modules()


def symbols(spark: SparkSession, catalogue: list[tuple]) -> DataFrame:
    """The catalogue as symbols of synthetic files, one per module; a module that can be imported
    as a whole is a symbol besides."""
    table = spark.createDataFrame(catalogue, SCHEMA)
    names = table.select("language_key", "qualifier", "name", "kind", F.col("flags").bitwiseOR(F.lit(STANDARD_LIBRARY)).alias("flags"))
    whole = table.filter("module_import is not null").select("language_key", "qualifier", F.col("module_import").alias("name")).distinct()
    whole = whole.select("*", F.lit(MODULE).alias("kind"), F.lit(MODULE_IMPORT | STANDARD_LIBRARY).alias("flags"))
    ext = F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSION.items() for x in pair]), F.col("language_key"))
    path = paths.synthetic_path(F.col("language_key"), F.col("qualifier"), ext)
    none = F.lit(None).cast("string")
    return names.unionByName(whole).select(path.alias("path"), "name", "kind", "flags", F.col("qualifier").alias("file_qualifier"), none.alias("parent_qualifier"))


def keyed(symbols: DataFrame) -> DataFrame:
    """Library symbols with the language key that their path states; whole modules do not count."""
    rows = symbols.filter(F.col("flags").bitwiseAND(F.lit(MODULE_IMPORT)) == 0)
    return rows.withColumn("language_key", F.split("path", "/")[1])


def counts(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("language_key").count()
