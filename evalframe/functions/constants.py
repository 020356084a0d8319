"""Fixed values that results must agree on.

FIXED VALUES: label names, verdict cues, gold-label synonyms, whitespace set,
error guidance texts (in lookup order), feedback / request templates, the
synthetic word list. They are stated here as text, in their natural order.
"""

# ---- FIXED VALUES: labels -------------------------------------------------
POSITIVE = "SUPPORTED"
NEGATIVE = "NOT_SUPPORTED"
LABELS = (POSITIVE, NEGATIVE)

# ---- FIXED VALUES: verdict cues, tested on the upper-cased reply in which a
# single blank and '-' became '_'. Negative cues win over positive ones.
VERDICT_NEGATIVE_CUES = ("NOT_SUPPORTED", "NOTSUPPORT", "REFUTE", "REFUTED", "CONTRADICT")
VERDICT_POSITIVE_CUES = ("SUPPORTED", "SUPPORTS", "ENTAIL")

# ---- FIXED VALUES: gold label synonyms (after strip, upper, ' ' -> '_').
GOLD_POSITIVE = ("SUPPORTED", "SUPPORTS", "ENTAILMENT", "TRUE")

# ---- FIXED VALUES: characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---- FIXED VALUES: execution statuses.
STATUS_PASSED = "passed"
STATUS_FAILED = "failed"
STATUS_SYNTAX = "syntax_error"
STATUS_RUNTIME = "runtime_error"
STATUS_TIMEOUT = "timeout"
STATUS_IMPORT = "import_error"
STATUS_LLM = "llm_error"

# ---- FIXED VALUES: error guidance, tried in this order; a key matches when it
# is contained (case-insensitively) in the status or in the error type.
ERROR_GUIDANCE = (
    ("syntax_error",
     "- The code has syntax errors and couldn't be parsed\n"
     "- Check for missing colons, parentheses, or indentation issues\n"
     "- Ensure the prompt asks for valid Python syntax"),
    ("timeout",
     "- The code took too long to execute (possible infinite loop)\n"
     "- Check for while loops without proper termination conditions\n"
     "- The prompt should emphasize efficient solutions"),
    ("AssertionError",
     "- The code ran but produced wrong output for test cases\n"
     "- The logic is incorrect - review the algorithm\n"
     "- Edge cases may not be handled properly"),
    ("TypeError",
     "- Type mismatch occurred during execution\n"
     "- Check function parameters and return types\n"
     "- The prompt should clarify expected input/output types"),
    ("IndexError",
     "- Array/list index out of bounds\n"
     "- Check loop bounds and edge cases (empty lists, etc.)\n"
     "- The prompt should emphasize handling edge cases"),
    ("KeyError",
     "- Dictionary key not found\n"
     "- Check for missing dictionary entries\n"
     "- Consider using .get() with defaults"),
    ("ValueError",
     "- Invalid value passed to a function\n"
     "- Check input validation and conversions\n"
     "- The prompt should mention input constraints"),
    ("MissingFunction",
     "- The required function was not found in the generated code\n"
     "- The prompt should clearly specify the function name to implement\n"
     "- Ensure the model outputs the complete function definition"),
)
DEFAULT_GUIDANCE = (
    "- Review the error message and traceback for specific issues\n"
    "- Consider what prompt modifications could prevent this error\n"
    "- Focus on clarity and completeness in the prompt"
)

# ---- FIXED VALUES: claims feedback notes.
CLAIMS_FEEDBACK_NOTES = (
    "Notes:\n"
    "- Keep prompt concise - the task model is ~8B parameters, avoid over-optimization\n"
    "- Focus on clarity over complexity"
)

# ---- FIXED VALUES: code feedback, passing case (after the code block).
CODE_PASS_NOTES = (
    "Notes for prompt optimization:\n"
    "- This is a successful case - the prompt worked well for this type of problem\n"
    "- Consider what aspects of the prompt helped produce correct code"
)

# ---- FIXED VALUES: few-shot generation request pieces.
FEWSHOT_REQUEST_HEADER = (
    "You are given a claim verification example. Produce exactly 3 few-shot examples (short) "
    "that are formatted as JSON array of objects with keys: 'input' and 'label' where label is "
    "either 'SUPPORTED' or 'NOT_SUPPORTED'.\n\n"
)
FEWSHOT_REQUEST_EXAMPLE = (
    "Return only a JSON array, e.g.:\n"
    "[\n"
    "  {\"input\": \"Claim: ... Context: ...\", \"label\": \"SUPPORTED\"},\n"
    "  {\"input\": \"Claim: ... Context: ...\", \"label\": \"NOT_SUPPORTED\"},\n"
    "  {\"input\": \"Claim: ... Context: ...\", \"label\": \"SUPPORTED\"}\n"
    "]\n\n"
)
FEWSHOT_REQUEST_FOOTER = "Keep each example short (one or two sentences per 'input').\n"

# ---- FIXED VALUES: reflection request (header reworded without product names).
REFLECTION_HEADER = "You are a prompt optimization reflector for an evolutionary prompt optimization system."
REFLECTION_FOOTER = (
    "Your job: Suggest a concise, actionable modification to the system prompt that would "
    "prevent this error in the next iteration.\n\n"
    "Output format (plain text, no formatting):\n"
    "MUTATION_ANALYSIS: [brief analysis of root cause]\n"
    "SUGGESTED_PROMPT_CHANGE: [specific instruction to add or modify in the system prompt]\n"
    "PRIORITY_LEVEL: [HIGH/MEDIUM/LOW based on error frequency impact]"
)
REFLECTION_CHANGE_MARKER = "SUGGESTED_PROMPT_CHANGE:"
REFLECTION_ANALYSIS_MARKER = "MUTATION_ANALYSIS:"
REFLECTION_PRIORITY_MARKER = "PRIORITY_LEVEL:"
REFLECTION_NO_CHANGE = "See log"

# ---- FIXED VALUES: synthetic claim words.
SYNTHETIC_WORDS = (
    "the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog",
    "ai", "model", "data", "evidence", "claim", "verify",
)

# ---- FIXED VALUES: failure defaults when a field is absent from the input.
FAILURE_DEFAULTS = {
    "task_id": "unknown",
    "entry_point": "unknown",
    "error_type": "UNKNOWN",
    "error_message": "No error message",
    "traceback": "",
}
