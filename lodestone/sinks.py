"""What leaves the engine besides tables: JSON documents and reports, Markdown reports, event streams, progress lines, batched writes."""

from __future__ import annotations

import json
import os
import queue
import threading
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that wait before they are written.
FLUSH_ROWS = 512


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def json_array(row: Column, order: Column) -> Column:
    """An aggregate: the rows of a group as one JSON array, in order. For groups that are bounded by their meaning, as reports are."""
    return F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), row.alias("v")))), lambda r: r["v"]), {"ignoreNullFields": "false"})


def json_object(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def write_report(path: str, report: dict) -> str:
    """A summary as an indented JSON file that appears when it is whole; its folder is made."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part := f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
    os.replace(part, path)
    return path


def table_text(df: DataFrame, most: int = 50) -> str:
    """The first rows as aligned text."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    widths = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows)])


def markdown_report(title: str, sections: dict[str, DataFrame | str], at: str) -> str:
    """A heading and a fenced block for each probe; one that fails says why, the others stand."""
    out = [f"# {title}", "", f"Generated at: {at}"]
    for name, df in sections.items():
        try:
            text = df if isinstance(df, str) else table_text(df)
        except Exception as e:  # a report of what could be read
            text = f"failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
        out += ["", f"## {name}", "", "```text", text, "```"]
    return "\n".join(out) + "\n"


def event_text(event: dict) -> str:
    """One server-sent event."""
    return f"event: {event['event']}\ndata: {json.dumps(event, ensure_ascii=False)}\n\n"


def parse_events(text: str) -> list[dict]:
    out = []
    for block in text.replace("\r\n", "\n").split("\n\n"):
        data = "\n".join(x[5:].lstrip() for x in block.split("\n") if x.startswith("data:"))
        if data:
            out.append(json.loads(data))
    return out


def event_stream(run: Callable[[Callable[[dict], None], Callable[[], bool]], object]) -> Iterator[str]:
    """The events of a run as they come. When the reader closes the stream, the run is asked to stop at its next chunk."""
    waiting: queue.Queue = queue.Queue()
    gone, told = threading.Event(), []

    def emit(event: dict) -> None:
        told.append(event["event"])
        waiting.put(event_text(event))

    def work() -> None:
        try:
            run(emit, gone.is_set)
        except Exception as e:  # the reader gets it as an event
            if "error" not in told:
                emit({"event": "error", "message": str(e).splitlines()[0] if str(e) else type(e).__name__})
        finally:
            waiting.put(None)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    try:
        while (text := waiting.get()) is not None:
            yield text
    finally:
        gone.set()
        thread.join()


def flush_batches(rows: Iterable, write: Callable[[list], None], size: int = FLUSH_ROWS, progress: Callable[[int], None] | None = None) -> int:
    """Writes rows of a local stream in batches, the last one as short as it is; gives their number. (Tables are written by Spark as a whole.)"""
    batch, n = [], 0
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            write(batch)
            n, batch = n + len(batch), []
            if progress:
                progress(n)
    if batch:
        write(batch)
        n += len(batch)
        if progress:
            progress(n)
    return n
