"""What runs on workers needs no copy of the package there."""

import os
import subprocess
import sys

from pyspark import cloudpickle
from termloom.llm import alignment, embeddings, jaccard, language, language_model, licenses, packing, secrets, suffixes, warc, whitening


def test_functions_travel_by_value(tmp_path):
    used = [
        jaccard.shingle_sets, jaccard.deals, jaccard.class_id, jaccard.similar, jaccard.parity_sketch, embeddings.codes, embeddings.unit, language.hashed_grams, language.score, language.Model, licenses.Matcher,
        whitening.scaled, whitening.spectral, alignment.Aligner, alignment.groups_of, suffixes.anchors, suffixes.merged, suffixes.equal_windows, suffixes.unpacked,
        language_model.stream, language_model.slopes, language_model.costs, language_model.Code, language_model.Model, packing.WordCache, secrets.Scanner, secrets.redact_text, warc.parse_archive, warc.capture, warc.url_key, warc.decode_block,
    ]
    (tmp_path / "data").write_bytes(cloudpickle.dumps(used))
    code = "import sys\nfrom pyspark import cloudpickle\nfs = cloudpickle.loads(open('data', 'rb').read())\nassert 'termloom' not in sys.modules\nprint(len(fs), [len(list(fs[0]([b'a b c d e f'])))])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == f"{len(used)} [1]", said.stderr[-500:]
