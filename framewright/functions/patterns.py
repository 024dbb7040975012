"""Fixed values that must equal the reference rules for identical results.

Everything in this module is data (regular expressions, word lists, text
templates), kept together and in natural order.  Java regex flags are used:
``(?U)`` makes ``\\s``, ``\\w``, ``\\b`` and ``\\d`` Unicode-aware like
Python 3 ``re`` on ``str``; ``(?i)`` is case-insensitive matching.
"""

# --- fixed values: listing structure -------------------------------------

# Pieces of a listing: a new one begins at each identifier that heads or ends a procedure
# (``<name> proc near``, ``<name> endp``); only those with an ``_`` can answer to a name.
PROC_SPLIT = r"(?iU)(?<!\w)(?=\w*_\w+\s+(?:proc\s+near|endp))"
PROC_MARKER = r"(?iU)^(\w*_\w+)\s+(?:proc\s+near|endp)"
PROC_HEADER = r"(?iU)^\w*_\w+\s+proc\s+near"

# Comment line of a listing (after stripping): ';' or a ?liveN@M: marker.
LIVE_MARKER = r"(?U)^\?live\d+@\d+:"

# --- fixed values: frame allocation ---------------------------------------

# Explicit allocation inside the first 40 lines of a procedure.
ALLOC_LINE = r"(?iU)(add\s+esp\s*,\s*-([0-9a-f]+h?)|sub\s+esp\s*,\s*([0-9a-f]+h?))"
ALLOC_WINDOW_LINES = 40

# Push fallback inside the first 15 lines, stopped by the first call/jmp.
PUSH_STOP = r"(?iU)^\s*(call|jmp)\b"
PUSH_REG = r"(?iU)^\s*push\s+(eax|ebx|ecx|edx|esi|edi)\b"
PUSH_WINDOW_LINES = 15
PUSH_BYTES = 4

# --- fixed values: variable locations -------------------------------------

# First write into the frame: mov/fstp/fst/fistp/fisttp [ebp +- N].
WRITE_EBP = (r"(?iU)(?:mov|fstp|fst|fistp|fisttp)\s+"
             r"(?:(?:dword|word|byte|qword)\s+ptr\s*)?\[ebp\s*([+\-]\s*[0-9a-f]+h?)\]")
# Any frame reference [ebp +- N] (first one of a line is used).
ANY_EBP = r"(?iU)\[ebp\s*([+\-]\s*[0-9a-f]+h?)\]"
# Declaration-only comment, ignored when looking for mentions.
DECL_COMMENT = r"(?U);\s*(?:volatile\s+)?(?:int|char|short|double|float|long|struct|unsigned)\b"
# Register facts written in comments: ``REG = var`` or ``REG = &var``.
REG_FACT = r"(?iU)\b([a-z]{2,3})\s*=\s*&?(\w+)"
# Registers accepted from register facts.
REGISTERS = ["eax", "ebx", "ecx", "edx", "esi", "edi", "esp", "ebp"]
# Variables with this prefix are pointers: no slot of their own.
POINTER_PREFIX = "ptr_"

# --- fixed values: sanitizing ---------------------------------------------

SANITIZE_DROP_PREFIXES = [";", "?live", "?debug"]

# --- fixed values: C function cut -----------------------------------------

# ``<name> ( ... ) {``, name inserted escaped; dot matches newline.
C_SIGNATURE_TEMPLATE = r"(?sU)\b{name}\s*\([^)]*\)\s*\{{"
# Where a signature of a plain word begins, and where a piece ends after each brace.
C_SIGNATURE_START = r"(?U)(?<!\w)(?=\w+\s*\([^)]*\)\s*\{)"
C_BRACE_END = r"(?<=[{}])"

# --- fixed values: chat formatting ----------------------------------------

# Target JSON keys, in output order.
TARGET_KEYS = ["stack_allocation_instruction", "stack_allocation_size_bytes",
               "variable_mappings"]
TARGET_VARIABLE_KEYS = ["variable_name", "assembly_reference", "allocation_space_offset"]

# Instruction prompt.  Placeholders: {registry}, {c_source}, {asm_source}.
PROMPT_TEMPLATE = """You are a binary analysis engine specialised in Borland C 32-bit (x86) compilation.

    ### Task
    For each variable in the Registry, identify its stack location in the assembly.

    ### Borland Stack Conventions
    - Stack frame set up with `push ebp / mov ebp,esp / add esp,-N` (or `push ecx` for small frames).
    - Locals are at `[ebp-N]` (negative offsets from EBP).
    - Parameters are at `[ebp+N]` (positive offsets).
    - When `add esp,-4092` appears, a second `add esp,-M` usually follows for large frames.
    - A variable may be cached in a register via `lea reg,[ebp-N]`; trace the register to find N.
    - Register-allocated variables (never address-taken) have `assembly_reference: "register <reg>"` and `allocation_space_offset: null`.

    ### Variable Registry (name + declared size in bytes — do NOT invent other variables)
    {registry}

    ### C Source
    ```c
    {c_source}
    ```

    ### Assembly
    ```asm
    {asm_source}
    ```

    ### Output Format
    Respond with ONLY a JSON object, no prose, no markdown fences:
    {{
    "stack_allocation_instruction": "<the add/sub/push instruction(s) that allocate the frame, pipe-separated if multiple>",
    "stack_allocation_size_bytes": <total bytes allocated>,
    "variable_mappings": [
        {{
        "variable_name": "<name from registry>",
        "assembly_reference": "ebp-<N>",
        "allocation_space_offset": <-N>
        }}
    ]
    }}
    """

# Public ChatML markers (role header, end of turn) and the generation cue.
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"

# Sequence budget of the trainer (tokens).
MAX_SEQ_LENGTH = 4096

# --- fixed values: splitting -----------------------------------------------

SPLIT_SEED = 42
VAL_FRACTION = 0.20

# --- strict JSON test (a value of our own) -----------------------------------

# Sentinel appended after a candidate so trailing text is detected.
JSON_SENTINEL = "fw#sentinel#7f3a"
