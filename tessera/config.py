"""Fixed values of the file-naming standard: entities, orders, vocabularies and path patterns."""

from __future__ import annotations

# Entity names and the patterns whose first group is the value.
ENTITIES: list[tuple[str, str]] = [
    ("subject", r"[/\\]+sub-([a-zA-Z0-9+]+)"),
    ("session", r"[_/\\]+ses-([a-zA-Z0-9+]+)"),
    ("sample", r"[_/\\]+sample-([a-zA-Z0-9+]+)"),
    ("task", r"[_/\\]+task-([a-zA-Z0-9+]+)"),
    ("tracksys", r"[_/\\]+tracksys-([a-zA-Z0-9+]+)"),
    ("acquisition", r"[_/\\]+acq-([a-zA-Z0-9+]+)"),
    ("nucleus", r"[_/\\]+nuc-([a-zA-Z0-9+]+)"),
    ("volume", r"[_/\\]+voi-([a-zA-Z0-9+]+)"),
    ("ceagent", r"[_/\\]+ce-([a-zA-Z0-9+]+)"),
    ("staining", r"[_/\\]+stain-([a-zA-Z0-9+]+)"),
    ("tracer", r"[_/\\]+trc-([a-zA-Z0-9+]+)"),
    ("reconstruction", r"[_/\\]+rec-([a-zA-Z0-9+]+)"),
    ("direction", r"[_/\\]+dir-([a-zA-Z0-9+]+)"),
    ("run", r"[_/\\]+run-(\d+)"),
    ("proc", r"[_/\\]+proc-([a-zA-Z0-9+]+)"),
    ("modality", r"[_/\\]+mod-([a-zA-Z0-9+]+)"),
    ("echo", r"[_/\\]+echo-([0-9]+)"),
    ("flip", r"[_/\\]+flip-([0-9]+)"),
    ("inv", r"[_/\\]+inv-([0-9]+)"),
    ("mt", r"[_/\\]+mt-(on|off)"),
    ("part", r"[_/\\]+part-(imag|mag|phase|real)"),
    ("recording", r"[_/\\]+recording-([a-zA-Z0-9+]+)"),
    ("space", r"[_/\\]+space-([a-zA-Z0-9+]+)"),
    ("chunk", r"[_/\\]+chunk-([0-9]+)"),
    ("suffix", r"(?:^|[_/\\])([a-zA-Z0-9+]+)\.[^/\\]+$"),
    ("scans", r"(.*\_scans.tsv)$"),
    ("fmap", r"(phasediff|magnitude[1-2]|phase[1-2]|fieldmap|epi)\.nii"),
    ("datatype", r"[/\\]+(anat|beh|dwi|eeg|fmap|func|ieeg|meg|micr|motion|mrs|nirs|perf|pet)[/\\]+"),
    ("extension", r"[^./\\](\.[^/\\]+)$"),
]

# Entities that derivatives add.
DERIVATIVE_ENTITIES: list[tuple[str, str]] = [
    ("atlas", r"atlas-([a-zA-Z0-9+]+)"),
    ("roi", r"roi-([a-zA-Z0-9+]+)"),
    ("label", r"label-([a-zA-Z0-9+]+)"),
    ("desc", r"desc-([a-zA-Z0-9+]+)"),
    ("from", r"(?:^|_)from-([a-zA-Z0-9+]+).*xfm"),
    ("to", r"(?:^|_)to-([a-zA-Z0-9+]+).*xfm"),
    ("mode", r"(?:^|_)mode-([a-zA-Z0-9+]+).*xfm"),
    ("hemi", r"hemi-(L|R)"),
    ("segmentation", r"seg-([a-zA-Z0-9+]+)"),
    ("res", r"res-([a-zA-Z0-9+]+)"),
    ("den", r"den-([a-zA-Z0-9+]+)"),
    ("model", r"model-([a-zA-Z0-9+]+)"),
    ("subset", r"subset-([a-zA-Z0-9+]+)"),
]

# The canonical order of entities.
ENTITY_ORDER: list[str] = [
    "subject", "session", "sample", "task", "tracksys", "acquisition", "ceagent", "staining", "tracer", "reconstruction", "direction", "run",
    "modality", "echo", "flip", "inversion", "mtransfer", "part", "processing", "hemisphere", "space", "split", "recording", "chunk", "atlas",
    "resolution", "density", "label", "description", "suffix", "extension", "datatype",
]

#: Short names that stand for an entry of the canonical order.
ORDER_ALIASES = {"inv": "inversion", "mt": "mtransfer", "proc": "processing", "hemi": "hemisphere", "res": "resolution", "den": "density", "desc": "description"}

# File types and their name endings; the first that fits counts.
FILE_TYPES: list[tuple[str, list[str]]] = [
    ("image", [".dtseries.nii", ".func.gii", ".nii.gz", ".nii", ".gii"]),
    ("data", [".tsv.gz", ".tsv"]),
    ("json", [".json"]),
    ("eeg", [".edf", ".bdf", ".set", ".vhdr", ".eeg", ".fdt"]),
    ("meg", [".fif", ".ds", ".sqd", ".con", ".raw", ".pdf"]),
    ("nirs", [".snirf"]),
    ("microscopy", [".ome.tif", ".ome.tiff", ".tif", ".tiff", ".svs"]),
]

# Extensions of more than one part.
COMPOUND_EXTENSIONS = [".dtseries.nii", ".func.gii", ".ome.tif", ".ome.tiff", ".nii.gz", ".tsv.gz"]

# Entity prefixes in file names.
PREFIXES = {
    "subject": "sub", "session": "ses", "sample": "sample", "task": "task", "tracksys": "tracksys", "acquisition": "acq", "nucleus": "nuc",
    "volume": "voi", "ceagent": "ce", "staining": "stain", "tracer": "trc", "reconstruction": "rec", "direction": "dir", "run": "run", "proc": "proc",
    "modality": "mod", "echo": "echo", "flip": "flip", "inv": "inv", "mt": "mt", "part": "part", "recording": "recording", "space": "space",
    "chunk": "chunk", "desc": "desc", "label": "label", "res": "res", "den": "den", "hemi": "hemi", "atlas": "atlas",
}

# Vocabularies.
DATATYPES = ["anat", "beh", "dwi", "eeg", "fmap", "func", "ieeg", "meg", "micr", "motion", "mrs", "nirs", "perf", "pet"]
SUFFIXES = [
    "T1w", "T2w", "T2star", "FLAIR", "PD", "PDT2", "inplaneT1", "inplaneT2", "angio", "defacemask", "bold", "cbv", "sbref", "phase", "dwi", "phasediff",
    "magnitude1", "magnitude2", "phase1", "phase2", "fieldmap", "epi", "events", "physio", "stim", "channels", "electrodes", "coordsystem", "eeg", "ieeg",
    "meg", "headshape", "photo", "pet", "blood", "asl", "m0scan", "aslcontext", "asllabeling", "motion", "nirs", "optodes", "svs", "mrsi", "unloc", "mrsref",
    "TEM", "SEM", "uCT", "BF", "DF", "PC", "DIC", "FLUO", "CONF", "participants", "scans", "sessions", "regressors", "timeseries",
]
EXTENSIONS = [
    ".nii", ".nii.gz", ".json", ".tsv", ".tsv.gz", ".bval", ".bvec", ".edf", ".bdf", ".set", ".fdt", ".vhdr", ".vmrk", ".eeg", ".fif", ".dat", ".pos", ".sqd",
    ".con", ".ds", ".snirf", ".mefd", ".nwb", ".png", ".tif", ".ome.tif", ".ome.btf", ".jpg",
]

# Suffixes and datatypes of the recordings of a modality.
MODALITIES = {
    "eeg": (["eeg"], ["eeg"]), "ieeg": (["ieeg"], ["ieeg"]), "meg": (["meg"], ["meg"]), "nirs": (["nirs"], ["nirs"]), "pet": (["pet"], ["pet"]), "asl": (["asl"], ["perf"]),
    "m0scan": (["m0scan"], ["perf"]), "motion": (["motion"], ["motion"]), "mrs": (["svs", "mrsi", "unloc", "mrsref"], ["mrs"]),
    "micr": (["TEM", "SEM", "uCT", "BF", "DF", "PC", "DIC", "FLUO", "CONF"], ["micr"]), "beh": (["beh", "events"], ["beh"]),
}
