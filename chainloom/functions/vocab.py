"""The words, selectors, topics, addresses and bounds results depend on."""

from __future__ import annotations

# Addresses and hashes.
ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
USDC = "0x3600000000000000000000000000000000000000"
NATIVE_USDC = "0xfffffffffffffffffffffffffffffffffffffffe"
POOL_MANAGER = "0x8366a39cc670b4001a1121b8f6a443a643e40951"
UNIVERSAL_ROUTER = "0x4fca4a51ab4f23a7447b3284fbd7d73289a89fb1"
POSITION_MANAGER = "0x6049c9a0e26405c0985f9e3685c87d0ae917f82b"
PERMIT2 = "0x000000000022d473030f116ddee9f6b43ac78ba3"
UNISWAP_FACTORY = "0xf0db7b58379503491d857db50ac9ece64c653918"
AERODROME_FACTORY = "0xb89df768af2cfe637ceb352c587fe8edaf491d03"

# ERC-4337 EntryPoints v0.6, v0.7 and v0.8.
ENTRYPOINTS = [
    "0x5ff137d4b0fdcd49dca30c7cf57e578a026d2789",
    "0x0000000071727de22e5e9d8baf0edac6f37da032",
    "0x4337084d9e255ff0702461cf8895ce9e3b5ff108",
]

# Names shown for known addresses.
KNOWN_NAMES = {
    ZERO_ADDRESS: "Mint / burn",
    POOL_MANAGER: "Uniswap v4 Pools",
    UNIVERSAL_ROUTER: "Uniswap Router",
    PERMIT2: "Permit2",
}

# The two faces of USDC as a pool currency (label, decimals).
USDC_FACES = {ZERO_ADDRESS: ("USDC (native)", 18), USDC: ("USDC", 6)}

NATIVE_DECIMALS = 18
LIVE_DECIMALS = 6

# The order in which facts are read out.
FACT_ORDER = [
    "bridge", "liquidity", "lending", "vault", "swap", "market",
    "batch", "payout", "wrap", "signed", "smart_account", "fee",
]

# The words of each fact in a lane sentence.
FACT_PHRASE = {
    "swap": "tokens were swapped on an exchange",
    "bridge": "funds were sent across chains through a bridge",
    "liquidity": "pool liquidity changed",
    "lending": "a loan was opened, repaid or liquidated",
    "vault": "funds were deposited into or withdrawn from a vault",
    "wrap": "USDC was wrapped or unwrapped",
    "market": "tokens were bought or sold on a marketplace",
    "batch": "a batch of payments was sent to many recipients",
    "payout": "rewards or payouts were claimed or distributed",
    "signed": "the payer signed an authorization and someone else submitted it",
    "smart_account": "it was sent by a smart account",
    "fee": "a fee was taken",
}

# The words that differ in a story sentence.
STORY_PHRASE = {
    **FACT_PHRASE,
    "liquidity": "liquidity was added to or removed from a pool",
    "signed": "a gasless signed payment: the payer signed an authorization and someone else submitted it",
}

# Function selector -> fact.
FACT_BY_SELECTOR = {
    # swap
    "0x3593564c": "swap", "0x04e45aaf": "swap", "0x38ed1739": "swap", "0x0c307f76": "swap", "0x0d5f0e3b": "swap",
    "0xf2c42696": "swap", "0x44014e98": "swap", "0x4d819a2a": "swap", "0xe21fd0e9": "swap", "0x07ed2379": "swap",
    "0x2f139e4f": "swap", "0x3e0f9c3c": "swap", "0x2213bc0b": "swap", "0x2afaca20": "swap", "0x40993b26": "swap",
    # bridge
    "0x8e0250ee": "bridge", "0x779b432d": "bridge", "0x57ecfd28": "bridge", "0xdeff4b24": "bridge",
    "0x7e7fc653": "bridge", "0x3ce33bff": "bridge", "0x6e1537da": "bridge",
    # liquidity
    "0xdd46508f": "liquidity",
    # marketplace
    "0x87201b41": "market", "0xf2d12b12": "market", "0xe7acab24": "market",
    # batch payments
    "0xe63d38ed": "batch", "0xc73a2d60": "batch", "0x51ba162c": "batch",
    # payouts
    "0x1e83409a": "payout", "0x4e71d92d": "payout", "0xe4fc6b6d": "payout",
    # signed
    "0xe3ee160e": "signed", "0xef55bec6": "signed",
    # smart account
    "0x765e827f": "smart_account", "0xb61d27f6": "smart_account", "0x34fcd5be": "smart_account",
    "0x2d9fb478": "smart_account",
}

# Topics named below.
SWAP_V3 = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
SWAP_V2 = "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
MINT_V3 = "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde"
BURN_V3 = "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c"
COLLECT_V3 = "0x70935338e69775456a85ddef226c395fb668b63fa0115f5f20610b388e6ca9c0"
DEPOSIT_FOR_BURN_2 = "0x0c8c1cbdc5190613ebd485511d4e2812cfa45eecb79d845893331fedad5130a5"
DEPOSIT_FOR_BURN_1 = "0x2fa9ca894982930190727e75500a97d8dc500233a5065e0f3126c48fbe0343c0"
MINT_AND_WITHDRAW_2 = "0x50c55e915134d457debfa58eb6f4342956f8b0616d51a89a3659360178e1ab63"
MINT_AND_WITHDRAW_1 = "0x1b2a7ff080b8cb6ff436ce0372e399692bbfb6d4ae5766fd8d58a7b8cc6142e6"
RELAY_DEPOSIT = "0x49fed1d0b752ce30eee63c7a81133f3363b532fec5d4d7dd1ccfd005de4555e1"
LIFI_STARTED = "0xcba69f43792f9f399347222505213b55af8e0b0b54b893085c2e27ecbe1644f1"
LIFI_SWAPPED = "0x7bfdfdb5e3a3776976e53cb0607060f54c5312701c8cba1155cc4d5394440b38"
LIFI_GENERIC = "0x38eee76fd911eabac79da7af16053e809be0e12c8637f156e77e1af309b99537"
OKX_ORDER = "0x1bb43f2da90e35f7b0cf38521ca95a49e68eb42fac49924930a5bd73cdf7576c"
FILLED_RELAY = "0x44b559f101f8fbcc8a0ea43fa91a05a729a5ea6e14a7c75aa750374690137208"
OUTPUT_FILLED = "0xfef24569acf839f2b5cb23fd59d8a9bcc21650ff711ac1961ca3c5d4681ffe12"
INCREASE_LIQUIDITY = "0x0f8712c47eb813e705bf827a60bdd551e6f2e055b4a1c2004304d52208a5a513"
ERC4626_DEPOSIT = "0xdcbc1c05240f31ff3ad067ef1ee35ce4997762752e3a095284754544f4c709d7"
ERC4626_WITHDRAW = "0xfbde797d201c681b91056529119e0b02407c7bb96a4a2c75c01fc9667232c8db"
WRAP_DEPOSIT = "0xe1fffcc4923d04b559f4d29a8bfc6cda04eb5b0d3c460751c2402c5c5cc9109c"
WRAP_WITHDRAWAL = "0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65"
BORROW = "0xb3d084820fb1a9decffb176436bd02558d15fac9b0ddfed8c465bc7359d7dce0"
REPAY = "0xa534c8dbe71f871f9f3530e97a74601fea17b426cae02e1c5aee42c96c784051"
ORDER_FULFILLED = "0x9d9af8e38d66c62e2c12f0225249fd9d721c54b83f48d9352c97c6cacdcb6f31"
CLAIMED = "0xf7a40077ff7a04c7e61f6f26fb13774259ddf1b6bce9ecf26a8276cdd3992683"
AUTHORIZATION_USED = "0x98de503528ee59b575ef0c0a2576a82497bfc029a5685b209e9ec333479b10a5"
USER_OPERATION = "0x49628fd1471006c1482da88028e9ce4dbb080b815c9b0344d39e5a8e6ec1419f"
OKX_FEE = "0x7970b0744fdb6cf0b120e5e0a5f4da3ab8cbec6d5d9ec8a4f327ccc1d8a5eb8b"
FEES_FORWARDED = "0x3a7029951ba36c1af37954df919ce2f9a95c3f5c2c2e872d5e7fd47c61a6df26"
HOOK_FEE = "0xc532c43b3423e14ef72748f1c8291238829ca0af8ba9b67975ad1483485a4b4d"

# Event topic -> fact.
FACT_BY_TOPIC = {
    # swap
    SWAP_V3: "swap",
    "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f": "swap",
    SWAP_V2: "swap",
    "0x8619026a40d38bedb4002fe511cea4bc4a9b336710efe8f21a61869a7ee0f02a": "swap",
    "0xd6d4f5681c246c9f42c203e287975af1601f8df8035a9251f79aab5c8f09e2f8": "swap",
    "0x20efd6d5195b7b50273f01cd79a27989255356f9f13293edc53ee142accfdb75": "swap",
    LIFI_SWAPPED: "swap",
    LIFI_GENERIC: "swap",
    OKX_ORDER: "swap",
    "0x7724394874fdd8ad13292ec739b441f85c6559f10dc4141b8d4c0fa4cbf55bdb": "swap",
    "0xa6fee24309b1d83d9ec7b9e4dbb73c6f882746efbfb26db7b7d9e9f2fb6dc95a": "swap",
    "0x2c5cc05b9a7b53e2478a9af1c94ec079b5be7c669be3df98ad86d28237f689e7": "swap",
    "0xec36bf571f136799e8dc0b0b8bea4b04d8bd3d43de838aab0d5fc21d4cbfc455": "swap",
    "0xc1742a443d639e06cae611e6969aa3e066a8edf9ca632e4d45b9167f487d1785": "swap",
    "0x8113d738abdcb6b38357e9d53a54a7157861a09031b453651f0fe7fe151f59df": "swap",
    "0xcf93b133041e0c9edcb77b3088a72ce25e769d56f3df661c1b0db04a3fe7fa0d": "swap",
    # bridge
    DEPOSIT_FOR_BURN_2: "bridge",
    DEPOSIT_FOR_BURN_1: "bridge",
    MINT_AND_WITHDRAW_2: "bridge",
    MINT_AND_WITHDRAW_1: "bridge",
    "0x8c5261668696ce22758910d05bab8f186d6eb247ceac2af2e82c7dc17669b036": "bridge",
    RELAY_DEPOSIT: "bridge",
    LIFI_STARTED: "bridge",
    FILLED_RELAY: "bridge",
    OUTPUT_FILLED: "bridge",
    # liquidity
    INCREASE_LIQUIDITY: "liquidity",
    "0x26f6a048ee9138f2c0ce266f322cb99228e8d619ae2bff30c67f8dcf9d2377b4": "liquidity",
    "0x40d0efd1a53d60ecbf40971b9daf7dc90178c3aadc7aab1765632738fa8b8f01": "liquidity",
    COLLECT_V3: "liquidity",
    BURN_V3: "liquidity",
    MINT_V3: "liquidity",
    "0xf208f4912782fd25c7f114ca3723a2d5dd6f3bcc3ac8db5af63baa85f711d5ec": "liquidity",
    # vault
    ERC4626_DEPOSIT: "vault",
    ERC4626_WITHDRAW: "vault",
    # wrap
    WRAP_DEPOSIT: "wrap",
    WRAP_WITHDRAWAL: "wrap",
    # lending
    BORROW: "lending",
    "0x2b627736bca15cd5381dcf80b0bf11fd197d01a037c52b927a881a10fb73ba61": "lending",
    REPAY: "lending",
    "0x3115d1449a7b732c986cba18244e897a450f61e1bb8d589cd2e69e6c8924f9f7": "lending",
    "0xe413a321e8681d831f4dbccbca790d2952b56f977908e45be37335533e005286": "lending",
    # marketplace
    ORDER_FULFILLED: "market",
    # payouts
    CLAIMED: "payout",
    "0xf7576d8c2653e9d07af5ef229acf59b339e327d4e0eaddb4a96615534cf148f8": "payout",
    "0x2105469e420e4f1c383a7b27c355d98d617715055986873b1963dedba114d59c": "payout",
    "0x9def4e2802183d68ce90a6a226a2962b59298616c27165f12c4fbc5c84cdd778": "payout",
    # signed
    AUTHORIZATION_USED: "signed",
    # smart account
    USER_OPERATION: "smart_account",
    # fee
    OKX_FEE: "fee",
    "0xcd5eae9d9d0b96532bd1b7dbf6628ce436b2af735829087a03c548439f8bf850": "fee",
    "0x3cfb523a4c38d88561dd3bf04805a31715c8b5fc468a03b8d684356f360dea99": "fee",
    "0x205442d60b70af1203d43cab62352c3b69b94f091be32fe683198057282b5c92": "fee",
    FEES_FORWARDED: "fee",
    "0x2cbc7a49494b955fc97f275d59dab3e8cb331287723f93b9505b81482cfd1b98": "fee",
    HOOK_FEE: "fee",
}

# Topics of pools that answer factory().
POOL_TOPICS = [SWAP_V3, MINT_V3, BURN_V3, COLLECT_V3, SWAP_V2]

# Logs that mean a token moved (Transfer, TransferSingle, TransferBatch).
MOVEMENT_TOPICS = [
    TRANSFER_TOPIC,
    "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62",
    "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb",
]

# Empty input, transfer, transferFrom.
PLAIN_SELECTORS = ["0x", "0xa9059cbb", "0x23b872dd"]

# Facts that say who sent a transaction or what it cost.
INCIDENTAL_FACTS = ["smart_account", "fee"]

# Protocol rules, first match wins: (name, selectors, topics).
PROTOCOL_RULES = [
    ("CCTP", ["0x8e0250ee", "0x779b432d", "0x57ecfd28"],
     [DEPOSIT_FOR_BURN_2, DEPOSIT_FOR_BURN_1, MINT_AND_WITHDRAW_2, MINT_AND_WITHDRAW_1]),
    ("Relay", [], [RELAY_DEPOSIT]),
    ("LI.FI", [], [LIFI_STARTED, LIFI_GENERIC, LIFI_SWAPPED]),
    ("OKX DEX", ["0x0c307f76", "0x0d5f0e3b", "0xf2c42696", "0x44014e98"], [OKX_ORDER]),
    ("KyberSwap", ["0xe21fd0e9"], []),
    ("1inch", ["0x07ed2379"], []),
    ("0x", ["0x2213bc0b"], []),
]
VENUE_ENTRY_POINTS = [UNIVERSAL_ROUTER, POSITION_MANAGER]
FACTORY_NAMES = {UNISWAP_FACTORY: "Uniswap", AERODROME_FACTORY: "Aerodrome"}

# Marks of a bridge leaving and of one arriving.
BRIDGE_OUT = [
    "0x8e0250ee", "0x779b432d", "0x6e1537da", "0x3ce33bff",
    DEPOSIT_FOR_BURN_2, DEPOSIT_FOR_BURN_1, RELAY_DEPOSIT, LIFI_STARTED,
]
BRIDGE_IN = [
    "0x57ecfd28", "0xdeff4b24", "0x7e7fc653",
    MINT_AND_WITHDRAW_2, MINT_AND_WITHDRAW_1, FILLED_RELAY, OUTPUT_FILLED,
]

# A size in words beside an amount bucket.
SIZE_WORDS = {
    "less than one cent of USDC": "dust",
    "under 1 USDC": "less than a dollar",
    "1 to 100 USDC": "a small amount",
    "100 to 10,000 USDC": "a medium amount",
    "over 10,000 USDC": "a large amount",
}

# The lanes a scorer chooses from, in order, with their text.
LANES = {
    "swap": "tokens were swapped on an exchange or traded on a marketplace",
    "bridge": "funds were sent to or arrived from another chain through a bridge, even if tokens were also swapped",
    "liquidity": "pool liquidity changed, even if tokens were also swapped",
    "vault": "funds were deposited into or withdrawn from a vault, or USDC was wrapped or unwrapped",
    "lending": "a loan was opened, repaid or liquidated",
    "signed_payment": "the payer signed an authorization and someone else submitted it",
    "payment": "a plain direct transfer, with nothing else happening",
    "spam": "zero or less than one cent of USDC moved and nothing else recognisable happened",
}
LANE_ORDER = [*LANES, "issuance", "uncertain", "no_transfer"]
LANES_ALWAYS = [*LANES, "issuance"]
UNCERTAIN_BELOW = 0.35

# Why a ruled lane was ruled.
RULED_WHY = {
    "issuance": "Ruled: USDC was minted or burned — the zero address is a party.",
    "spam": "Ruled: no USDC moved and nothing else recognisable happened.",
    "uncertain": "Ruled: the transfer gave too little to read.",
    "no_transfer": "Ruled: nothing was transferred in this transaction.",
}

# Fact -> lane, first match wins.
FACT_LANES = [
    ("bridge", "bridge"), ("liquidity", "liquidity"), ("lending", "lending"), ("vault", "vault"),
    ("swap", "swap"), ("market", "swap"), ("batch", "payment"), ("payout", "payment"),
    ("wrap", "vault"), ("signed", "signed_payment"),
]

RULE_PREFIX = "About this Arc USDC transfer: "
LANE_QUESTION = "What kind of Arc transaction is this?"
CONTROL_QUESTION = "does this operation sing?"
CONTROL_FIRES = 0.5
CHAIN = "Arc"
