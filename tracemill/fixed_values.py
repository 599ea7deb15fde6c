"""Constants and texts that must be exactly these for results to agree.

Fixed values: everything in this file is a given constant, message text or
format. ``{name}`` marks a place filled from a column.
"""

# ---------------------------------------------------------------- fixed values
# Numbers

IGNORED_LABEL = -100
PAD_LENGTH = 4096
READING_CHAR_WEIGHT = 0.1
WRITING_CHAR_WEIGHT = 0.5
DISCOUNT_PER_TOKEN = 0.999
LIKELIHOOD_THRESHOLD = 0.8
TOKENS_AFTER_STATE = 20
NEXT_STATE_TOKENS = 10
MAX_CYCLES = 30
END_OF_TURN_LENGTH = 10
WEIGHT_FLOOR = 0.01
WEIGHT_CEILING = 100.0
TEST_FRACTION = 0.2
LONGEST_COMPLETION = 100
SHORTEST_COMPLETION = 1
GENERATION_ATTEMPTS = 5
EASY_BELOW = 1000
MEDIUM_BELOW = 2000

# Names

PLATFORM = "codeforces"
CODE_PLACEHOLDER = "# YOUR CODE HERE\n"
EMPTY_CASES = "[]"
EMPTY_METADATA = "{}"
FENCE = "```"
PYTHON_FENCE = "```python"
CHOOSERS = ("empowerment", "longest", "random", "longest_random", "shortest")
ACTIONS = ("accept", "reject", "finish")
RATIO_ACTIONS = ("accept", "append", "finish", "reject")
OUTDATED_COLUMNS = (
    "input_ids_state",
    "attention_mask_state",
    "input_ids_state_ar",
    "attention_mask_state_ar",
    "input_ids_next_state",
    "attention_mask_next_state",
    "completion",
)
DERIVED_SUBSTRINGS = ("input_ids", "attention_mask", "empowerment")
DERIVED_NAMES = (
    "labels",
    "hn_code",
    "completion",
    "null_code",
    "final_codes",
    "next_states",
)

# Chat template (the public Llama 3 layout)

CHAT_BEGIN = "<|begin_of_text|>"
CHAT_HEADER_OPEN = "<|start_header_id|>"
CHAT_HEADER_CLOSE = "<|end_header_id|>\n\n"
CHAT_END_OF_TURN = "<|eot_id|>"

# Question prompt

QUESTION_HEAD = "### Question:\n{question}\n\n"
QUESTION_WITH_STARTER = """### Format: You will use the following starter code to write the solution to the problem and enclose your code within delimiters.
```python
{starter}
```

"""
QUESTION_WITHOUT_STARTER = """### Format: Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.
```python
# YOUR CODE HERE
```

"""
QUESTION_TAIL = "### Answer: (use the provided format with backticks)\n\n"

# Generation prompt

GENERATION_SYSTEM = """You are an expert Python programmer. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. 
*Please do not provide any sample outputs or testcases in your response. Additionally, you are only allowed to solve the problem *ONCE*. 
Do not attempt to retry your solution if you are unhappy with it.
For example, if your solution is in a function called `solve`, you should only define one function called `solve`. DO NOT try to retry it if you think it has a bug.
For example, you should not write `solve2` if you think `solve` has a bug. Only the first solution will be counted, so simply stop writing once the first solution is finished--even if it is not correct."""
GENERATION_CONTINUED = "\n```python\n{code}"

# Prompt from code alone

BLIND_SYSTEM = """You are an expert Python programmer. You will be provided with a code snippet and will be asked to finish the program.
You will not be able to see the question--instead, you should just finish the program however you see fit.
"""
BLIND_USER = """Please finish the code below:
```python
{code}
```"""
BLIND_CONTINUED = "```python\n{code}"

# Acceptor prompt

ACCEPTOR_SYSTEM = """You are an expert Python programming agent. You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests. 

The way you will compose your program is by interacting with the file editing interface through tools. 
In addition, you will be assisted by an automated assistant that will sometimes propose suggested completions to whatever you are typing. 
At every step you will first write your thoughts on the suggestion and whether it correctly continues your solution, or instead introduces bugs.
Please *only consider the assistant suggestion* in your decision to accept the suggestion, reject the suggestion, or finish and submit your code for testing.
Previous code that you have written is not able to be changed, so you should only look at the changes the assistant is proposing.
At the very end of your thought process, you will write one word to specify which action you are taking.
Unless you take the "finish" action, you will be prompted afterwards to write what you would like to append to your program.
Therefore, please accept suggestions as long as they do not introduce bugs, and either help you solve the problem or improve the quality of your code.
It's ok if the the suggested completion is incomplete, because you can always append to it later.

You will first be prompted to write your thoughts on the suggestion.
Afterwords, you will be prompted to write which action you would like to take.

Here are the actions you have access to:
### "accept"
    description: Accepts a suggested completion given by an intelligent assistant. The suggested completion will then be incorporated into the code you have written.
### "reject"
    description: Rejects a suggested completion given by an intelligent assistant. The suggested completion will not be incorporated into the code you have written.
### "finish"
    description: Tells the editor that you have finished writing the program and to run the testcases. Only call this tool if you are confident that your program is finished. You will not be prompted to write any more code after calling this tool.

Remember, you will be able to continue writing your program regardless of whether you accept the suggested completion or not.
As long as the suggested completion does not introduce bugs, and either helps you solve the problem or improves the quality of your code, you should accept it.
DO NOT reject a suggestion because it is "minor" or "short". Only reject the suggestion if it is wrong, introduces a bug, or otherwise sets you back.
"""
ACCEPTOR_CODE = """```python
        {code}
        ```"""
ACCEPTOR_VIEW = """
## You have written the following code:
```python
{code}
```

## Suggested Completion
Here is what your code would look like with a suggested completion: 
```python
{suggestion}
```

## Suggested Completion diff
For clarity, here is the diff between your current code and the suggested completion code:
{change} 

## Instructions:
What do you think of the suggested completion? Do you think it is solving the question correctly, or does it introduce a bug or error?
Please write down your thoughts. You are not allowed to write any new code in your response, only your thoughts on whether the suggested completion helps you on your way to solving the problem, or otherwise improves the quality of your code.
It is ok if the the suggested completion is incomplete, because you will be prompted to append to it later.
You are also not able to take any actions at this stage.
"""
ACCEPTOR_FOLLOW_UP = """Now, please write which action you would like to take. 
Remember, the actions available are "accept" to accept the suggested completion, "reject" to reject the suggested completion, and "finish" to finish writing your code and run the tests.
Please only call "finish" if you are confident that your code is correct and you are ready to run the tests.
"""
ACCEPTOR_CONTINUED = "Therefore, I would like to "
CHANGE_SUMMARY = "{added} lines added, {removed} lines removed"

# Assistant prompt

ASSISTANT_SYSTEM = """
You are assisting a human in a python code generation task. Your role is to provide suggested completions given
what they have already typed. Please try to infer what the human wants the next piece of code to be given the
code they have already written. If they have not written any code, please provide a good start to their program, such as with import statements or function definitions. 

The way you will compose your suggestion is by providing the next version of the code which would replace the current code. 
Please re-type the current code and then add in your suggested completion.
DO NOT output any other text, including no quotation marks.

## Remember to always re-type the code written so far and then add in your suggested completion.
If you don't re-type the code written so far *exactly as it is written* (with all of the functions, comments, import statements, etc)
an error will be raised.
"""
ASSISTANT_USER = """Now it's your turn! Please provide a completion for the following code:
```python
{code}
```"""
ASSISTANT_ANSWER = """Here is my suggested completion:
```python
{code}"""
EXAMPLE_ONE_CODE = """def twoSum(self, nums: List[int], target: int) -> List[int]:
    numMap = {}
    n = len(nums)

    # Build the hash table
    for i in range(n):
        numMap[nums[i]] = i

    # Find the complement
    for i in range(n):
"""
EXAMPLE_ONE_ANSWER = """def twoSum(self, nums: List[int], target: int) -> List[int]:
    numMap = {}
    n = len(nums)

    # Build the hash table
    for i in range(n):
        numMap[nums[i]] = i

    # Find the complement
    for i in range(n):
        complement = target - nums[i]```"""
EXAMPLE_TWO_CODE = "def whoami(name: "
EXAMPLE_TWO_ANSWER = """def whoami(name: str, age: int) -> str:
```"""
# ----------------------------------------------------------- end of fixed values
