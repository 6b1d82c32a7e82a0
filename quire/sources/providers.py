"""Reading providers: deterministic ones as expressions, external engines as plug-ins over Arrow batches.

A provider adds struct(text, confidence, provider) as `reading`; null stands for a failure.
"""

from __future__ import annotations

import importlib.util
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.cascade import READING, mean_confidence, reading


@dataclass
class Expression:
    """A provider of two expressions."""

    name: str
    text: Column
    confidence: Column

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("reading", reading(self.text, self.confidence, F.lit(self.name)))


@dataclass
class Engine:
    """An external engine: make() once a worker, then read(engine, input) gives (text, confidences) for each row of input_col.

    The confidence is their mean, or 0 and an empty text if nothing was read; an exception is a failure of that row alone."""

    name: str
    make: Callable[[], object]
    read: Callable[[object, object], tuple[str, list[float]]]
    input_col: str = "path"
    requires: tuple[str, ...] = ()
    credentials: tuple[str, ...] = ()  # variables of the environment, one of which must be set
    url: str | None = None  # answers with 200
    binaries: tuple[str, ...] = ()

    def available(self) -> bool:
        """Whether libraries, a credential, the service and programs are there, as far as the engine needs them."""
        modules = all(importlib.util.find_spec(m) is not None for m in self.requires)
        known = not self.credentials or any(os.environ.get(c) for c in self.credentials)
        return modules and known and all(shutil.which(b) for b in self.binaries) and (self.url is None or answers(self.url))

    def __call__(self, df: DataFrame) -> DataFrame:
        make, read, name, input_col = self.make, self.read, self.name, self.input_col

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = None
            for b in batches:
                rows = []
                for x in b[input_col]:
                    try:
                        engine = engine or make()
                        text, confidences = read(engine, x)
                        rows.append({"text": text, "confidence": sum(confidences) / len(confidences) if confidences else 0.0, "provider": name})
                    except Exception:  # noqa: BLE001  a failed reading is a null
                        rows.append(None)
                yield b.assign(reading=pd.Series(rows, index=b.index, dtype=object))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{schema}, reading {READING}")


def answers(url: str, seconds: float = 3.0) -> bool:
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=seconds) as found:
            return found.status == 200
    except (OSError, ValueError):
        return False


def lines_reading(lines: Column, provider: str) -> Column:
    """A reading of array<struct<text, confidence>>: the lines, stripped as a whole, and the mean of their confidences, 0 without any."""
    texts = F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return reading(strip(texts), mean_confidence(F.transform(lines, lambda x: x["confidence"])), F.lit(provider))


def word_confidence(pages: Column) -> Column:
    """Mean confidence of all words of pages of blocks of paragraphs of words; 0 without any."""
    deeper = lambda c, name: F.flatten(F.transform(c, lambda x: F.coalesce(x[name], F.filter(x[name], lambda _: F.lit(False)))))
    words = deeper(deeper(deeper(pages, "blocks"), "paragraphs"), "words")
    return F.coalesce(mean_confidence(F.transform(words, lambda w: w["confidence"])), F.lit(0.0))


def surya_lines(engine, path) -> tuple[str, list[float]]:
    """Text lines of all predictions of a page."""
    recogniser, detector = engine
    found = [line for prediction in recogniser([path], ["en"], detector) for line in prediction.text_lines]
    return "\n".join(x.text for x in found).strip(), [float(x.confidence) for x in found]


def vision_words(engine, path) -> tuple[str, list[float]]:
    """The cloud service's text, and the confidences of all its words."""
    client, vision = engine
    with open(path, "rb") as f:
        answer = client.document_text_detection(image=vision.Image(content=f.read()))
    whole = answer.full_text_annotation
    words = [float(w.confidence) for p in whole.pages for b in p.blocks for g in b.paragraphs for w in g.words] if whole else []
    return (whole.text or "") if whole else "", words


def rapid_lines(engine, path) -> tuple[str, list[float]]:
    """Lines joined, their scores."""
    found, _ = engine(path)
    return "\n".join(x[1] for x in found or []), [float(x[2]) for x in found or []]


def tesseract_modes(engine, path) -> tuple[str, list[float]]:
    """The best of the page modes, by mean word confidence."""
    from PIL import Image

    from quire.operators.cascade import LEAST_CHARS, MODES

    image, best = Image.open(path).convert("L"), ("", [])
    for mode in MODES:
        data = engine.image_to_data(image, config=f"--psm {mode}", output_type=engine.Output.DICT)
        words = [(t, float(c) / 100) for t, c in zip(data["text"], data["conf"], strict=True) if t.strip() and float(c) >= 0]
        conf, text = [c for _, c in words], " ".join(t for t, _ in words)
        if len(text.strip()) >= LEAST_CHARS and sum(conf) / len(conf) > (sum(best[1]) / len(best[1]) if best[1] else 0):
            best = (text, conf)
    return best


def ollama(url: str, model: str, prompt: str = "Transcribe the document.") -> Engine:
    """A local vision model: constant confidence 0.8."""

    def read(_, path) -> tuple[str, list[float]]:
        import base64
        import json
        import urllib.request

        with open(path, "rb") as f:
            body = {"model": model, "prompt": prompt, "images": [base64.b64encode(f.read()).decode()], "stream": False}
        request = urllib.request.Request(f"{url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=120) as answer:
            text = json.loads(answer.read())["response"].strip()
        return text, [0.8] if text else []

    return Engine("ollama", object, read, url=f"{url}/api/tags")


def known(name: str) -> Engine:
    """The engines that are shipped as connectors; their libraries are optional."""

    def rapid():
        from rapidocr_onnxruntime import RapidOCR

        return RapidOCR()

    def tesseract():
        import pytesseract

        return pytesseract

    def surya():
        from surya.detection import DetectionPredictor
        from surya.recognition import RecognitionPredictor

        return RecognitionPredictor(), DetectionPredictor()

    def vision():
        from google.cloud import vision

        return vision.ImageAnnotatorClient(), vision

    engines = {
        "surya": Engine("surya", surya, surya_lines, requires=("surya",)),
        "google_vision": Engine("google_vision", vision, vision_words, requires=("google",), credentials=("GOOGLE_APPLICATION_CREDENTIALS",)),
        "rapid_ocr": Engine("rapid_ocr", rapid, rapid_lines, requires=("rapidocr_onnxruntime",)),
        "tesseract": Engine("tesseract", tesseract, tesseract_modes, requires=("pytesseract", "PIL"), binaries=("tesseract",)),
    }
    return engines[name]
