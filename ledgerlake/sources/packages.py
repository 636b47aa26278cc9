"""Filings of several markets as one table of facts: spark.read.format("filing_facts").load(root).

A filing is a folder root/<market>/<filing_id>/ of files: XBRL instances (.xbrl, .xml), inline XBRL (.xhtml, .htm), JSON facts or
account rows (.json), or a .zip of them. Many filings are better kept in bulk archives, root/<market>/<any name>.zip, whose
members are <filing_id>/<file>: files of their own are each listed by the driver and opened by a task. What is listed is dealt
into partitions by bytes: a file whole, a bulk archive by ranges of bytes that its members start in; each task reads its own.
Files come through pyarrow.fs, so the root may be on any store it knows. A file that can't be read as what it should be gives
no facts.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import in_small_batches

FACTS = "market string, filing_id string, source_file string, source_type string, concept string, label string, value_text string, value decimal(38,6), unit string, context_ref string, period_start string, period_end string, instant string, dims map<string,string>"
#: Bytes of a partition.
SPLIT = 32 << 20
#: Currency of account rows that name none, by market.
ROW_CURRENCY = {"KR": "KRW", "JP": "JPY"}
INLINE = "http://www.xbrl.org/2013/inlineXBRL"


def number(text: object, scale: int = 0, sign: str | None = None) -> Decimal | None:
    """A printed number, in brackets or with a sign; None where it is none, or too large for the table."""
    raw = str(text if text is not None else "").strip().replace(",", "").replace("，", "")
    negative = bool(re.fullmatch(r"\(.*\)", raw)) or sign == "-"
    try:
        value = Decimal(raw.strip("()")).scaleb(scale)
    except InvalidOperation:
        return None
    return None if not value.is_finite() or abs(value) >= 10**32 else round(-value if negative else value, 6)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def qname(tag: str) -> str:
    """prefix:name of a tag or an attribute's value; the prefix is the last part of the namespace."""
    space, brace, name = tag.rpartition("}")
    if not brace:
        return tag
    return f"{'ifrs-full' if 'ifrs' in space.lower() else space.rstrip('/').rpartition('/')[2]}:{name}"


def _referred(root: ET.Element) -> tuple[dict[str, tuple], dict[str, str]]:
    """Contexts (start, end, instant, dims) and units by their ids."""
    contexts, units = {}, {}
    for node in root.iter():
        kind = _local(node.tag)
        if kind == "context":
            found = {_local(n.tag): (n.text or "").strip() for n in node.iter()}
            dims = {n.get("dimension"): (n.text or "").strip() for n in node.iter() if _local(n.tag) in ("explicitMember", "typedMember") and n.get("dimension")}
            contexts[node.get("id")] = (found.get("startDate"), found.get("endDate"), found.get("instant"), dims)
        elif kind == "unit":
            sides = [[(m.text or "").strip() for m in part.iter() if _local(m.tag) == "measure"] for side in ("unitNumerator", "unitDenominator") for part in node.iter() if _local(part.tag) == side]
            plain = [(m.text or "").strip() for m in node if _local(m.tag) == "measure"]
            units[node.get("id")] = "*".join(plain) if plain else "/".join("*".join(s) for s in sides)
    return contexts, units


def _xml_facts(data: bytes) -> Iterator[tuple]:
    """source_type, concept, label, value_text, value, unit, context_ref, start, end, instant, dims."""
    root = ET.fromstring(data)
    contexts, units = _referred(root)
    for node in root.iter():
        context = node.get("contextRef") or node.get("contextref")
        if context is None:
            continue
        inline = node.tag.startswith(f"{{{INLINE}}}")
        concept = node.get("name") or "" if inline else qname(node.tag)
        text = "".join(node.itertext()).strip() if inline else (node.text or "").strip()
        scale = node.get("scale") or "0"
        value = number(text, int(scale) if scale.lstrip("-").isdigit() else 0, node.get("sign"))
        if value is None or not concept:
            continue
        unit = node.get("unitRef") or node.get("unitref")
        start, end, instant, dims = contexts.get(context, (None, None, None, {}))
        yield "inline_xbrl" if inline else "xbrl", concept, _local(concept).rpartition(":")[2], text, value, units.get(unit, unit), context, start, end, instant, dims


def _json_facts(market: str, data: bytes) -> Iterator[tuple]:
    """Facts under "facts", or account rows under "list" with the amount of the current term."""
    payload = json.loads(data)
    rows = next((payload[k] for k in ("list", "facts", "single_company_accounts") if payload.get(k)), []) if isinstance(payload, dict) else []
    for row in rows if isinstance(rows, list) else []:
        concept = row.get("concept") or row.get("account_id") or row.get("account_nm")
        text = next((row[k] for k in ("thstrm_amount", "amount", "val", "value") if row.get(k) is not None), None)
        value = number(text)
        if not concept or value is None:
            continue
        api = "thstrm_amount" in row
        concept = str(concept) if ":" in str(concept) or not api else f"dart:{concept}"
        dims = row.get("dimensions") if isinstance(row.get("dimensions"), dict) else {}
        unit = row.get("currency") or row.get("unit") or ROW_CURRENCY.get(market)
        yield "account_row" if api else "json_fact", concept, str(row.get("account_nm") or row.get("label") or concept.rpartition(":")[2]), str(text), value, unit, row.get("context_ref"), row.get("period_start"), row.get("thstrm_dt") or row.get("period_end"), row.get("instant"), {str(k): str(v) for k, v in dims.items()}


def facts_of(market: str, name: str, data: bytes) -> Iterator[tuple]:
    """source_file and the fact's columns, of one file."""
    kind = name.lower().rpartition(".")[2]
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for inner in sorted(z.namelist()):
                    yield from facts_of(market, inner, z.read(inner))
        elif kind in ("xbrl", "xml", "xhtml", "htm", "html"):
            yield from ((name, *fact) for fact in list(_xml_facts(data)))
        elif kind == "json":
            yield from ((name, *fact) for fact in list(_json_facts(market, data)))
    except (ET.ParseError, zipfile.BadZipFile, json.JSONDecodeError, UnicodeDecodeError):
        return


def archive_facts(market: str, file, low: int, high: int) -> Iterator[tuple]:
    """market, filing and the fact's columns, of the members of a bulk archive that start in a range of its bytes."""
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, ValueError):  # the latter where a file is shorter than an archive's end
        return
    with archive:
        for member in archive.infolist():
            filing, _, inner = member.filename.partition("/")
            if not low <= member.header_offset < high or not inner or member.is_dir() or any(p.startswith((".", "_")) for p in member.filename.split("/")):
                continue
            try:
                data = archive.read(member)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):  # broken, packed otherwise or encrypted
                continue
            for fact in facts_of(market, inner.rpartition("/")[2], data):
                yield market, filing, *fact


def written_archives(rows: DataFrame, root: str) -> None:
    """Write filings (market, filing, name, text) as bulk archives, one a task and market. A task that runs again leaves the
    same archives: each is moved to its name once it is whole."""
    from pyarrow import fs

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        task, made = TaskContext.get(), {}
        name, waiting = f"part-{task.partitionId():05d}.zip", f".part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with ExitStack() as opened:
            for batch in batches:
                for market, filing, file, text in zip(batch["market"], batch["filing"], batch["name"], batch["text"]):
                    if market not in made:
                        store.create_dir(f"{base}/{market}")
                        stream = opened.enter_context(store.open_output_stream(f"{base}/{market}/{waiting}"))
                        made[market] = opened.enter_context(zipfile.ZipFile(stream, "w"))
                    made[market].writestr(f"{filing}/{file}", text.encode())
                yield batch[["filing"]]
        for market in made:
            store.move(f"{base}/{market}/{waiting}", f"{base}/{market}/{name}")

    in_small_batches(rows).select("market", "filing", "name", "text").mapInPandas(run, "filing string").count()


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, str | None, str, int, int]]  # market, filing, path within the file system, range of bytes; no filing: a bulk archive


class _Reader(DataSourceReader):
    def __init__(self, root: str, split: int):
        self.root, self.split = root, split

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, base = self._open()
        out, now, size = [], [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda f: f.path):
            parts = info.path[len(base.rstrip("/")) + 1 :].split("/")
            bulk = len(parts) == 2 and parts[1].lower().endswith(".zip")
            if not info.is_file or (len(parts) < 3 and not bulk) or any(p.startswith((".", "_")) for p in parts):
                continue
            for low in range(0, info.size, self.split) if bulk else (0,):
                high = min(low + self.split, info.size) if bulk else info.size
                if now and size + high - low > self.split:
                    out.append(_Files(now))
                    now, size = [], 0
                now.append((parts[0], None if bulk else parts[1], info.path, low, high))
                size += high - low
        return [*out, _Files(now)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = self._open()
        for market, filing, path, low, high in partition.paths:
            if filing is None:
                with store.open_input_file(path) as f:
                    yield from archive_facts(market, f, low, high)
                continue
            with store.open_input_stream(path) as f:
                data = f.read()
            for fact in facts_of(market, path.rpartition("/")[2], data):
                yield market, filing, *fact


class FilingFacts(DataSource):
    """Options: path; split_bytes, how many bytes of files a partition has."""

    @classmethod
    def name(cls) -> str:
        return "filing_facts"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT)))


def filing_facts(spark: SparkSession, root: str, split_bytes: int = SPLIT):
    spark.dataSource.register(FilingFacts)
    return spark.read.format("filing_facts").option("split_bytes", split_bytes).load(root)
