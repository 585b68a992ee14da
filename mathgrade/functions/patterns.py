"""Answer and block patterns that must equal the reference's
behaviour for the same texts to give the same numbers.

They are written once here, in the reference's order, as Java-compatible
regular expressions (a literal brace is escaped; everything else is as the
reference states it). The same strings are valid RE2, so the DuckDB oracle
uses them unchanged.
"""

# --- fixed values: number shapes ------------------------------------------
NUM_ANY = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"

# --- fixed values: A1 tag-or-hash (groups 1, 2) ----------------------------
TAG_OR_HASH = r"(?i)<answer>\s*([+-]?\d+(?:\.\d+)?)\s*</answer>|####\s*([+-]?\d+(?:\.\d+)?)\b"

# --- fixed values: A2/A3 six-way alternation (groups 1..7; 5/6 = fraction) -
SIX_WAY = (
    r"(?i)<answer>\s*([-+]?\d+(?:\.\d+)?)\s*</answer>"
    r"|####\s*([-+]?\d+(?:\.\d+)?)\b"
    r"|The final answer is[:\s]*([-+]?\d+(?:\.\d+)?)"
    r"|\\boxed\{\s*([-+]?\d+(?:\.\d+)?)(?:\\%|%)?\s*\}"
    r"|\\boxed\{\s*\\frac\{(\d+)\}\{(\d+)\}\s*\}"
    r"|The answer is[:\s]*([-+]?\d+(?:\.\d+)?)"
)

# --- fixed values: A4 ordered list, tried in this order, group 1 -----------
ORDERED_LIST = [
    r"The answer is\s+\$?\\?\(?boxed\)?\{?([0-9]+(?:\.[0-9]+)?)\}?",
    r"####\s*([\d,\.]+)",
    r"\(\s*\\?boxed\s*\{?\$?([\d,\.]+)\}?\)",
    r"\$?\\?boxed\s*\{?\$?([\d,\.]+)\}?",
    r"The final answer is\s+\$?\\?\(?boxed\)?\{?([0-9]+(?:\.[0-9]+)?)\}?",
    r"The final answer is\s+\$?([0-9]+(?:\.[0-9]+)?)",
    r"= ([0-9]+(?:\.[0-9]+)?)\s*[\.\)]?\s*$",
    r"\$?([0-9]+(?:\.[0-9]+)?)\s*(?:dollars|pounds|km|miles|liters)?",
]

# --- fixed values: A5 hybrid (boxed first, then last hit of each, then tail)
HYBRID_BOXED = r"\\?boxed\{\$?(-?\d+(?:\.\d+)?)\}"
HYBRID_LIST = [
    r"(?i)\bAnswer[:\-\s]+\$?(-?\d+(?:\.\d+)?)\b",
    r"(?i)\b(?:Therefore|Thus|Hence)[,:\s]+\$?(-?\d+(?:\.\d+)?)",
    r"(?i)\b(?:The (?:final\s+)?answer is)\s+\$?(-?\d+(?:\.\d+)?)",
    r"(?i)####\s*(-?\d+(?:\.\d+)?)",
    r"(?i)=\s*(-?\d+(?:\.\d+)?)[\.\)]?\s*$",
    r"(?i)(-?\d+(?:\.\d+)?)\s*(?:dollars|km|miles|liters|hours|minutes|seconds)\b",
]
HYBRID_TAIL = r"\b(-?\d+(?:\.\d+)?)\b"

# --- fixed values: A6 boxed integer list, group 1 (a fourth one has no group and never gives an integer) ----
BOXED_INT_LIST = [
    r"\\\(\s*\\boxed\{(\d+)\}\s*\\\)",
    r"\[[\s\S]*?\\boxed\{(\d+)\}[\s\S]*?\]",
    r"\\boxed\{(\d+)\}",
]

# --- fixed values: A7 / A9 hash number, A8 hash-or-phrase-or-boxed ---------
HASH_NUMBER = r"####\s*([0-9\.,\-]+)"
HASH_PHRASE_BOXED = r"(?:####\s*|The answer is\s*|boxed\s\{\s*)([0-9\.,\-]+)(?:\s*\})?"
# --- fixed values: A10 hash digits, A12 rest of line after hashes ----------
HASH_DIGITS = r"####\s*(\d+)"
HASH_REST_OF_LINE = r"#### (.*)"
# --- fixed values: A15 first number in program output (reference: unsigned)
PROGRAM_NUMBER_UNSIGNED = r"\b(\d+(?:\.\d+)?)\b"
PROGRAM_NUMBER_SIGNED = r"(-?\b\d+(?:\.\d+)?)\b"

# --- fixed values: T1-T3 candidate blocks ----------------------------------
CODE_BLOCK = r"(?is)<code>\s*```python\s*(.*?)\s*```.*?</code>"
CODE_BLOCK_LENIENT = r"(?s)<code>.*?```python(.*?)```(?:\s*```)?\s*</code>"
PYTHON_FENCE = r"(?i)```python\s*([\s\S]*?)\s*```"
TASK_BLOCK = r"(?is)<task>(.*?)</task>"
SOLUTION_BLOCK = r"(?is)<solution>(.*?)</solution>"
TASK_BLOCK_CS = r"(?s)<task>(.*?)</task>"
SOLUTION_BLOCK_CS = r"(?s)<solution>(.*?)</solution>"
GREEDY_CODE = r"(?s)<code>(.*)</code>"
GREEDY_TASK = r"(?s)<task>(.*)</task>"
GREEDY_SOLUTION = r"(?s)<solution>(.*)</solution>"
GREEDY_FENCE = r"(?s)```python\s*(.*?)(?:\s*```|$)"
ANSWER_TAG = r"(?s)<answer>.*?</answer>"

# --- fixed values: T8-T10 verifier output ----------------------------------
HARDER_QUESTION = r"(?s)Harder Question: (.*?)\nHarder Answer:"
HARDER_ANSWER = r"(?s)Harder Answer: (.*)"
VERIFICATION_TRUE = "Verification Result: True"
MATH_SOLUTION = r"Math Solution: (.*)"

# --- fixed values: T21 annotated calculation -------------------------------
ANNOTATED_CALC = r"<<[^<>]*=([^<>]*)>>"

# --- fixed values: T18/T19 step words, T22/T23 error markers ---------------
STEP_WORDS = [r"step\s+\d+", "first", "second", "third", "fourth", "fifth", "next", "finally", "lastly"]
STEP_ALTERNATION = "(" + "|".join(STEP_WORDS) + ")"
THINK_PHRASE = "let's think step by step"
FINAL_PHRASE = r"the (final |)answer is"
ANSWER_IS_WORD = r"(?i)\banswer is\b"

# --- fixed values: ChatML markers (D2, D4, D5) ------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ASSISTANT_TAG = "<|im_start|>assistant"

# --- fixed values: candidate verdicts (T24) --------------------------------
REASON_ACCEPTED = "accepted"
REASON_INCORRECT = "incorrect_code"
REASON_LOW_NOVELTY = "too_low_novelty"
REASON_LOW_DIFFICULTY = "too_low_difficulty"
REASON_FEW_STEPS = "too_few_steps"

# --- fixed values: error categories and their limits (T22, T23) --------------
ERROR_NONE, ERROR_CALCULATION, ERROR_INCOMPLETE, ERROR_APPROACH, ERROR_OTHER = (
    "No Answer", "Calculation Error", "Incomplete Answer", "Wrong Approach", "Other Error")
ERROR2_NONE, ERROR2_INCOMPLETE, ERROR2_CALCULATION, ERROR2_OTHER = "No answer", "Incomplete", "Calc error", "Other"
LONG_REASONING, SHORT_ANSWER = 200, 150

# --- fixed values: closing sentence of training answers (D1) -----------------
FINAL_SENTENCE, FINAL_SENTENCE_END = "\n\nThe final answer is: <answer> ", " </answer>"

# --- wording of this library: pairwise judge (T11) ---------------------------
JUDGE_TEMPLATE = ("Compare two answers to one question. Judge correctness first, then clarity.\nQuestion: {question}\n"
                  "Answer A: {answer_a}\nAnswer B: {answer_b}\nEnd with [[A]] or [[B]].")

# --- wording of this library: feedback of the iterative augmentation (U10) ---
FEEDBACK_MISSING = {"no_code": "The reply has no code block.", "no_task": "The reply has no task block.",
                    "no_solution": "The reply has no solution block.", "no_final_answer": "The solution has no final answer."}
FEEDBACK_MISMATCH = "The code does not print the solution's answer."
FEEDBACK_NOVELTY = "The novelty of this one is {score} of 10. Write a more novel one."
